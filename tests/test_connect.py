"""Components of graphs against brute force, and the rounds that they take."""

import random

from pyspark.sql import functions as F

from marlstone.operators import connect, graph


def reach(n, links):
    """What each node reaches, itself included."""
    out = {v: set() for v in range(n)}
    for a, b in links:
        out[a].add(b)
    found = {}
    for v in range(n):
        seen, todo = {v}, [v]
        while todo:
            for w in out[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        found[v] = seen
    return found


def shapes():
    rng = random.Random(7)
    chance = lambda n, m: [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    ring = lambda nodes: list(zip(nodes, nodes[1:] + nodes[:1]))
    yield "none", 3, []
    yield "self", 3, [(1, 1), (1, 2), (1, 2)]
    yield "ring", 9, ring([3, 8, 1, 5, 0])
    yield "rings on a chain", 14, ring([0, 1, 2]) + [(2, 13), (13, 3)] + ring([3, 4]) + [(4, 12), (12, 11), (11, 5)] + ring([5, 6, 7]) + [(7, 8)]
    yield "back by a chain", 8, [(0, 1), (1, 2), (2, 0), (2, 5), (5, 6), (6, 0), (2, 7), (3, 0), (4, 3)]
    yield "hub", 30, [(0, i) for i in range(1, 30)] + [(i, 0) for i in range(1, 30, 3)]
    yield "sparse", 60, chance(60, 60)
    yield "dense", 40, chance(40, 120)


def test_components_equal_brute_force(spark):
    """All shapes side by side, their nodes numbered in a mixed order."""
    links, n = [], 0
    for _, size, some in shapes():
        links, n = links + [(a + n, b + n) for a, b in some], n + size
    order = random.Random(3).sample(range(n), n)
    links = [(order[a], order[b]) for a, b in links]
    nodes = spark.createDataFrame([(f"n{v}", v + 100) for v in range(n)] + [("n1", 500)], "id string, seq long")
    # ends that are no nodes, nulls and columns that clash with those of the work
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1, 2) for a, b in links] + [("n0", "gone", 0, 0), ("gone", "n1", 0, 0), (None, "n1", 0, 0)], "source string, target string, number int, label int")
    forth = reach(n, links)
    both = reach(n, links + [(b, a) for a, b in links])
    sizes = lambda found: sorted((r["label"], r["size"]) for r in found.collect())
    count = lambda labels: sorted((100 + v, labels.count(v)) for v in set(labels))
    assert sizes(graph.components(nodes, edges)) == count([min(u for u in range(n) if v in forth[u]) for v in range(n)])
    assert sizes(graph.weak_components(nodes, edges)) == count([min(both[v]) for v in range(n)])
    same = [min(u for u in forth[v] if v in forth[u]) for v in range(n)]
    assert sorted((r["id"], r["label"]) for r in graph.strong_labels(nodes, edges).collect()) == sorted((f"n{v}", same[v] + 100) for v in range(n))


def test_links_on_cycles_equal_brute_force(spark):
    """A ring with a tail, a link back over a chain, a node with a link to itself, repeated links and nulls."""
    links = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 2), (5, 6), (6, 6), (6, 7), (6, 7), (7, 8)]
    forth = reach(9, links)
    rows = [(f"n{a}", f"n{b}") for a, b in links] + [(None, "n0"), ("n0", None)]
    found = graph.on_cycles(spark.createDataFrame(rows, "source string, target string"))
    assert sorted((r.source, r.target) for r in found.collect()) == sorted({(f"n{a}", f"n{b}") for a, b in links if a in forth[b]})


def test_no_nodes(spark):
    nodes, edges = spark.createDataFrame([], "id string, seq long"), spark.createDataFrame([], "source string, target string")
    for found in (graph.components, graph.weak_components, graph.strong_components):
        assert found(nodes, edges).collect() == []
    assert graph.on_cycles(edges).collect() == []


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds = []
    held = connect.written
    monkeypatch.setattr(connect, "written", lambda df: rounds.append(1) or held(df))
    took = {}
    for n in (100, 3200):  # five doublings
        # a chain whose numbers fall but for its start, which is the least of all
        at = F.col("id")
        links = spark.range(n - 1).select(F.when(at == 0, F.lit(0)).otherwise(F.lit(n) - at).alias("a"), (F.lit(n - 1) - at).alias("b"))
        nodes = spark.range(n).select(F.col("id").alias("number"))
        work = {"strong": lambda: connect.strong(links), "weak": lambda: connect.weak(links), "reaching": lambda: connect.reaching(nodes, links)}
        for name, made in work.items():
            rounds.clear()
            rows = made().collect()
            took[name, n] = len(rounds)
            assert len(rows) == (0 if name == "strong" else n) and len({r[1] for r in rows}) <= 1, name
    for name, n in took:
        assert took[name, 3200] - took[name, 100] <= 10, took
