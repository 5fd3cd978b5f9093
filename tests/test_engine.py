"""Golden values, edge cases, and every registered query against its DuckDB counterpart."""

import json
import math
import contextlib
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.columns import letter_jaccard, letters, words
from marlstone.operators import align, dense, expand, extract, fusion, graph, learner, linking, metrics, models, search, sparse
from marlstone.operators import text as T
from marlstone.plans import catalogue
from marlstone.sources import readers, sinks
from marlstone.streaming import tracing

SF = "/root/testdata/sf0.001"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- text


def test_clean_text(spark):
    rows = [(1, "L'été à — «x»   œuvre €5 #tag × ÷\n\tok", "fr"), (2, None, "fr"), (3, "学习。，abc's -x", "zh"), (4, "", "en")]
    out = {r.i: r.c for r in table(spark, rows, "i int, t string, l string").select("i", T.clean(F.col("t"), F.col("l")).alias("c")).collect()}
    assert out == {1: "L'été à  «x» uvre 5 tag × ÷ ok", 2: "", 3: "学习。abcs x", 4: ""}


@pytest.mark.parametrize(("n", "valid"), [(49, False), (50, True), (10000, True), (10001, False)])
def test_validity(spark, n, valid):
    assert table(spark, [("x" * n,)], "c string").select(T.is_valid(F.col("c"))).first()[0] is valid


def test_corpus_ids_and_counts(spark):
    rows = [(None, "t", "x" * 60, "fr", 7), ("a", "t", "short", "fr", 8), ("b", None, None, "fr", 9)]
    docs = table(spark, rows, "doc_id string, title string, content string, lang string, line_no int")
    assert [r.doc_id for r in T.clean_corpus(docs).collect()] == ["doc_fr_000007"]
    assert tuple(T.validity_counts(docs).first()) == (1, 2)


def test_words_keep_cjk_runs_and_dots(spark):
    assert table(spark, [("Ab.c d'e 深度学习 x_1..y",)], "t string").select(words(F.col("t"))).first()[0] == ["ab.c", "d", "e", "深度学习", "x_1", "y"]


# ---- retrieval


def test_bm25_by_hand(spark):
    docs = table(spark, [(1, "a", "x y x"), (2, "b", "y z"), (3, "", None)], "doc_id int, title string, content string")
    q = table(spark, [(9, "x"), (8, ""), (7, "nothing")], "qid int, query string")
    rows = sparse.bm25(docs, q).collect()
    idf = math.log(3 / 2) + 1
    assert [(r.qid, r.doc_id, r.rank) for r in rows] == [(9, 1, 1)]
    assert rows[0].score == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3))), abs=1e-8)


@pytest.mark.parametrize("shipped", [0, 32 << 20])
def test_dense_blocks_equal_a_plain_product(spark, monkeypatch, shipped):
    import numpy as np

    monkeypatch.setattr(dense, "SHIPPED", shipped)
    monkeypatch.setattr(dense, "BLOCK", 40)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 8))
    vectors = table(spark, [(i, x.tolist()) for i, x in enumerate(v)], "doc_id int, vector array<double>")
    queries = vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    for metric, score in (("dot", v @ v.T), ("cosine", (v @ v.T) / np.outer(*[np.linalg.norm(v, axis=1)] * 2)), ("l2", -np.linalg.norm(v[:, None] - v[None], axis=2))):
        got = {(r.qid, r["rank"]): r.doc_id for r in dense.exact(vectors, queries, 5, metric=metric).collect()}
        for q in range(0, 150, 20):
            assert [got[q, n] for n in range(1, 6)] == np.lexsort((np.arange(150), -np.round(score[q], 9)))[:5].tolist()
    with pytest.raises(ValueError):
        dense.exact(vectors, queries, metric="other")


def test_cells_find_near_vectors(spark):
    d = catalogue.D
    cells, centres = dense.build_cells(d.vectors(spark, SF), nlist=16)
    got = {(r.qid, r.doc_id) for r in dense.probe(cells, centres, d.vector_queries(spark, SF), 10, 12).collect()}
    want = {(r.qid, r.doc_id) for r in dense.exact(d.vectors(spark, SF), d.vector_queries(spark, SF), 10).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_l2_ranks_copies_by_target_at_every_size(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[np.arange(0, 3000, 20)] = v[np.arange(0, 3000, 20) % 400]  # groups of seven and eight copies
    vectors = table(spark, [(i, x.tolist()) for i, x in enumerate(v)], "entity int, vector array<double>")
    sources = vectors.where("entity % 20 = 0 or entity % 7 = 1")
    ids = [i for i in range(3000) if i % 20 == 0 or i % 7 == 1]
    assert len(ids) * v.size > 2e7
    got = {}
    for r in align.nearest_l2(vectors, sources, 5).collect():
        got.setdefault(r.source, {})[r["rank"]] = (r.target, r.distance)
    for q in ids:
        d = np.round(np.sqrt(((v[q] - v) ** 2).sum(1)), 9)
        assert [got[q][n] for n in range(1, 6)] == [(i, d[i]) for i in np.lexsort((np.arange(3000), d))[:5]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_cells_find_near_vectors_besides_the_query(spark, sf):
    d, path = catalogue.D, f"/root/testdata/{sf}"
    cells, centres = dense.build_cells(d.vectors(spark, path), nlist=catalogue.CELLS)
    got = {(r.qid, r.doc_id) for r in dense.probe(cells, centres, d.vector_queries(spark, path), 11, catalogue.PROBED).collect()}
    want = {(r.qid, r.doc_id) for r in dense.exact(d.vectors(spark, path), d.vector_queries(spark, path), 10, itself=False).collect()}
    assert len(got & want) / len(want) >= 0.9


# ---- metrics and fusion


def test_metrics_golden(spark):
    run = [("q1", d, n) for n, d in enumerate(["doc1", "doc3", "doc5", "doc2", "doc4"], 1)] + [("q2", d, n) for n, d in enumerate(["doc2", "doc4", "doc1", "doc5"], 1)] + [("q9", "doc1", 1)]
    rel = [("q1", "doc1", 3), ("q1", "doc2", 2), ("q1", "doc3", 1), ("q1", "doc4", 0), ("q2", "doc1", 2), ("q2", "doc2", 3), ("q2", "doc5", 1), ("q3", "doc1", 1)]
    scores = metrics.per_query(table(spark, run, "qid string, doc_id string, rank int"), table(spark, rel, "qid string, doc_id string, rel int"))
    got = {r.qid: r for r in scores.collect()}
    assert set(got) == {"q1", "q2"}
    assert got["q1"].ndcg == pytest.approx(0.9499797323) and got["q2"].ndcg == pytest.approx(0.9508013339)
    assert got["q1"].ap == pytest.approx(0.9166666667) and got["q2"].ap == pytest.approx(0.8055555556)
    assert got["q1"].mrr == got["q1"].recall == 1.0 and got["q1"].precision == pytest.approx(0.3)
    assert {r.metric: r.value for r in metrics.summary(scores).collect()}["map"] == pytest.approx(0.8611111111)
    everyone = table(spark, [("q1",), ("q2",), ("q3",), ("q4",)], "qid string")
    assert {r.metric: r.value for r in metrics.summary(scores, everyone).collect()}["mrr"] == 0.5


def test_metrics_without_relevance(spark):
    run = table(spark, [("q", "a", 1), ("q", "a", 2)], "qid string, doc_id string, rank int")
    zero = metrics.per_query(run, table(spark, [("q", "a", 0)], "qid string, doc_id string, rel int")).first()
    assert tuple(zero)[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    twice = metrics.per_query(run, table(spark, [("q", "a", 1)], "qid string, doc_id string, rel int")).first()
    assert twice.ndcg > 1 and twice.recall == 1.0 and twice.precision == 0.1


def parts(spark):
    rows = [("q", "doc1", "dense", 0.9, 1), ("q", "doc3", "dense", 0.7, 2), ("q", "doc2", "sparse", 5.0, 1), ("q", "doc4", "sparse", 1.0, 2), ("q", "doc5", "kg", 0.4, 1)]
    return table(spark, rows, "qid string, doc_id string, source string, score double, rank int")


def test_fusion(spark):
    got = {r.doc_id: (r.fused_score, r["rank"]) for r in fusion.fuse(parts(spark)).collect()}
    assert got == {"doc1": (0.4, 1), "doc2": (0.3, 2), "doc5": (0.3, 3), "doc3": (0.0, 4), "doc4": (0.0, 5)}
    rrf = {r.doc_id: r.fused_score for r in fusion.fuse(parts(spark), "rrf").collect()}
    assert rrf["doc1"] == pytest.approx(0.4 / 61, abs=1e-8) and rrf["doc4"] == pytest.approx(0.3 / 62, abs=1e-8)
    assert fusion.weights(0.4, 0.3, 0) == pytest.approx((4 / 7, 3 / 7, 0)) and fusion.weights(0.4, 0.3, 0.3) == (0.4, 0.3, 0.3)
    with pytest.raises(ValueError):
        fusion.fuse(parts(spark), "other")
    rows = fusion.explained(fusion.fuse(parts(spark), k=1)).collect()
    assert {(r.source, r.score, round(r.contribution, 6)) for r in rows} == {("dense", 1.0, 0.4), ("sparse", 0.0, 0.0), ("kg", 0.0, 0.0)}


def test_ablation_leaves_out_sources_without_weight(spark):
    runs = {(r.run, r.doc_id) for r in fusion.ablation(parts(spark)).collect()}
    assert {d for r, d in runs if r == "dense_only"} == {"doc1", "doc3"} and len({r for r, _ in runs}) == 7


# ---- graph

NODES = "id string, name string, lang string, type string, seq long"
EDGES = "source string, target string, type string, weight double, seq long"


def test_hops_expand_each_node_once(spark):
    edges = table(spark, [("a", "b", "PREREQUISITE", 0.9, 1), ("b", "a", "RELATED_TO", 0.5, 2), ("b", "c", "IS_A", 0.4, 3), ("c", "d", "IS_A", 0.4, 4), ("c", "x", "IS_A", 0.1, 5)], EDGES)
    seeds = table(spark, [(1, "a")], "seed int, id string")
    got = sorted((r.hop, r.source, r.target) for r in expand.hops(seeds, edges, 3).collect())
    assert got == [(1, "a", "b"), (2, "b", "a"), (2, "b", "c"), (3, "c", "d"), (3, "c", "x")]
    assert expand.hops(seeds, edges, 3, fan_out=1).count() == 2
    paths = expand.shortest(table(spark, [("a",)], "start string"), table(spark, [("d",), ("a",)], "end string"), edges, 3).collect()
    assert [(r.end, r.length, r.path) for r in paths] == [("d", 3, ["a", "b", "c", "d"])]


def test_path_scores_golden(spark):
    rows = [(1, 2, ["PREREQUISITE", "RELATED_TO"], [0.9, 0.9]), (2, 1, ["RELATED_TO"], [0.6]), (3, 3, ["PART_OF", "PART_OF", "PART_OF"], [0.6, 0.6, 0.6]), (4, 1, [], None)]
    got = {r.i: r for r in expand.scored_paths(table(spark, rows, "i int, length int, relations array<string>, weights array<double>")).collect()}
    assert got[1].score == pytest.approx(0.331091, abs=1e-6) and got[2].score == pytest.approx(0.388180, abs=1e-6) and got[3].score == pytest.approx(0.138341, abs=1e-6)
    assert got[4].weight_score == got[4].relation_score == 0.5


def test_graph_building(spark):
    mentions = table(spark, [("Paris", "fr", "LOCATION", "d1", 1), ("paris", "fr", "CONCEPT", "d2", 2), ("Paris", "en", "LOCATION", "d3", 3), ("", "fr", "X", "d", 4), ("Zug", "de", None, "d", 5)], "name string, lang string, type string, source_doc string, seq long")
    nodes = graph.nodes(mentions)
    assert sorted(r.id for r in nodes.collect()) == ["de_CONCEPT_000000", "en_LOCATION_000001", "fr_LOCATION_000000"]
    edges = graph.edges(table(spark, [("PARIS", "zug", None), ("Paris", "nowhere", "X"), ("", "Zug", "X")], "head string, tail string, type string"), nodes)
    assert [tuple(r) for r in edges.collect()] == [("fr_LOCATION_000000", "de_CONCEPT_000000", "RELATED_TO")]
    last = graph.upsert(table(spark, [("a", 1, 1), ("a", 2, 2)], "id string, w int, seq long"), ["id"]).first()
    assert last.w == 2


def test_components_depend_on_direction(spark):
    nodes = table(spark, [(x, x, "en", "C", i) for i, x in enumerate("abcd")], NODES)
    edges = table(spark, [("b", "a", "X", 1.0, 1), ("c", "d", "X", 1.0, 2), ("d", "zz", "X", 1.0, 3)], EDGES)
    assert sorted(r["size"] for r in graph.components(nodes, edges).collect()) == [1, 1, 2]
    assert sorted(r["size"] for r in graph.weak_components(nodes, edges.where("target <> 'zz'")).collect()) == [2, 2]
    cyclic = table(spark, [("a", "b", "PREREQUISITE", 1.0, 1), ("b", "c", "PREREQUISITE", 1.0, 2), ("c", "a", "PREREQUISITE", 1.0, 3), ("c", "d", "ALIGNED_WITH", 1.0, 4)], EDGES)
    assert sorted((r.rule, r.source) for r in graph.ontology_violations(nodes, cyclic).collect()) == [("aligned_within_language", "c"), ("prerequisite_cycle", "a"), ("prerequisite_cycle", "b"), ("prerequisite_cycle", "c")]


def test_linking(spark):
    nodes = table(spark, [("n1", "grammar", "en", "C", 1), ("n2", "grammaire", "fr", "C", 2), ("n3", "grammars", "en", "C", 3)], NODES)
    asked = table(spark, [("grammar", "auto", None), ("grammar", "fr", None), ("", "en", None)], "mention string, lang string, type string")
    got = linking.fuzzy(asked.limit(1), nodes).collect()
    assert [(r.id, r["rank"]) for r in got] == [("n1", 1), ("n3", 2), ("n2", 3)]
    assert {(r.mention, r.id) for r in linking.link(asked.where("lang = 'fr' OR mention = ''"), nodes).collect()} == {("grammar", "n2")}
    both = linking.exact_then_fuzzy(table(spark, [("grammar",), ("grammai",), ("zzz",)], "mention string"), nodes).collect()
    assert {(r.mention, r.id, r.method) for r in both} == {("grammar", "n1", "exact"), ("grammai", "n2", "fuzzy")}
    assert table(spark, [("ab c", "cab")], "a string, b string").select(letter_jaccard(letters(F.col("a")), letters(F.col("b")))).first()[0] == 0.75


def test_relations(spark):
    rows = [(1, "Algebra requires arithmetic. ALGEBRA requires arithmetic"), (2, "算术是代数的基础"), (3, "La grammaire précède la syntaxe: guide.pdf"), (4, None)]
    got = {(r.doc_id, r.relation, r.source, r.target) for r in extract.relations(table(spark, rows, "doc_id int, content string")).collect()}
    assert got == {(1, "prerequisite", "Algebra", "arithmetic"), (1, "prerequisite", "ALGEBRA", "arithmetic"), (2, "prerequisite", "算术", "代数"), (3, "prerequisite", "grammaire", "la"), (3, "has_resource", "syntaxe", "guide.pdf")}


def test_alignment_training_is_repeatable(spark):
    edges = table(spark, [(f"en_{i}", f"fr_{i % 3}", "X", 1.0, i) for i in range(9)], EDGES)
    a, b = ([tuple(r) for r in align.trained(edges).collect()] for _ in range(2))
    assert a == b and len(a) == 12
    assert align.nearest_cosine(align.trained(edges), align.trained(edges).limit(2), "fr", 2).count() == 4


# ---- learner


def events(spark, rows):
    return table(spark, rows, "learner_id long, concept_id string, event_type string, ts double, seq long, success boolean, duration double")


def test_mastery_fold(spark):
    rows = [(1, "c", "view", 0.0, 1, None, 5.0), (1, "c", "practice", 1.0, 2, True, 5.0), (1, "c", "practice", 1.0, 3, None, 5.0), (1, "c", "odd", 86400.0, 4, True, 5.0)]
    p = 0.1 + 0.9 * 0.09
    p = p * 0.9 / (p * 0.9 + (1 - p) * 0.2)
    p = p + (1 - p) * 0.3
    kept = math.exp(-0.05)
    assert learner.mastery(events(spark, rows), 2 * 86400.0).first().mastery == pytest.approx(p * kept + 0.1 * (1 - kept), abs=1e-8)
    assert tracing.step(0.5, "practice", None) == 0.5 and tracing.decayed(0.1, 30) == pytest.approx(0.1)


def test_topological_order():
    rng = random.Random(1)
    for _ in range(50):
        names = [f"c{i}" for i in range(12)]
        needs = [(names[j], names[i]) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.2]
        score = {n: rng.random() for n in names}
        out = learner.ordered(names, needs, score)
        assert sorted(out) == sorted(names) and all(out.index(n) < out.index(c) for c, n in needs)
    assert learner.ordered(["a", "b", "c"], [("a", "b"), ("b", "a")], {"a": 0.5, "b": 0.1, "c": 0.9}) == ["c", "b", "a"]


def test_learning_path_stops_at_mastered_concepts(spark):
    chain = ["alphabet", "pronunciation", "vocabulary", "grammar", "writing"]
    needs = table(spark, list(zip(chain[1:], chain)), "concept string, needs string")
    scores = table(spark, list(zip([1] * 5, chain, [0.9, 0.7, 0.4, 0.2, 0.0])), "learner_id long, concept_id string, mastery double")
    wanted = learner.closure(table(spark, [(1, "writing")], "learner_id long, concept string"), needs, scores)
    assert {r.concept for r in wanted.collect()} == {"pronunciation", "vocabulary", "grammar", "writing"}
    path = learner.learning_path(wanted, needs, scores).orderBy("position").collect()
    assert [(r.concept_id, r.reason) for r in path] == [("pronunciation", "review"), ("vocabulary", "consolidate"), ("grammar", "weak"), ("writing", "goal")]
    assert learner.next_steps(learner.learning_path(wanted, needs, scores)).first().later == "vocabulary → grammar → writing"


# ---- sources, sinks, streams


def test_files(spark, tmp_path):
    (tmp_path / "qrels.tsv").write_text("qid\tdoc_id\trelevance\n# note\nq1\td1\t2\nq1\td1\t3\nbad\n")
    (tmp_path / "run.txt").write_text("q1 Q0 d2 2 0.5 x\nq1 Q0 d1 1 0.9 x\nshort line\n")
    (tmp_path / "corpus_fr.jsonl").write_text('{"doc_id": "a", "content": "one"}\nnot json\n{"doc_id": "a", "text": "two"}\n')
    (tmp_path / "edges.jsonl").write_text('{"source": "a", "target": "b", "properties": {"weight": 0.4}}\n{"source": "a"}\n')
    (tmp_path / "queries.jsonl").write_text('{"qid": "q", "query": "old"}\n{"qid": "q", "text": "new"}\n')
    at = str(tmp_path)
    assert [tuple(r) for r in readers.qrels(spark, f"{at}/qrels.tsv").collect()] == [("q1", "d1", 3)]
    assert sorted(tuple(r) for r in readers.run(spark, f"{at}/run.txt").collect()) == [("q1", "d1", 1), ("q1", "d2", 2)]
    assert readers.corpus(spark, readers.corpus_files(spark, at)[0]).first().content == "two"
    assert readers.corpus_files(spark, at)[0].endswith("corpus_fr.jsonl")
    assert [(r.type, r.weight) for r in readers.edges(spark, f"{at}/edges.jsonl").collect()] == [("RELATED_TO", 0.4)]
    assert [r.query for r in readers.queries(spark, f"{at}/queries.jsonl").collect()] == ["new"]
    run = table(spark, [("q1", "d1", 1, 0.5)], "qid string, doc_id string, rank int, score double")
    sinks.run(run, f"{at}/trec", "trec")
    assert spark.read.text(f"{at}/trec").first().value == "q1 Q0 d1 1 0.500000 FUSION"
    sinks.metrics_json(table(spark, [("mrr", 0.5)], "metric string, value double"), f"{at}/m", "x")
    assert json.loads(spark.read.text(f"{at}/m").first().value) == {"run": "x", "metrics": {"mrr": 0.5}}
    shown = sinks.table(table(spark, [("a", 0.5), ("b", 0.7)], "run string, mrr double"))
    assert "| b | **0.7000** |" in shown and "| a | 0.5000 |" in shown
    with pytest.raises(ValueError):
        sinks.run(run, at, "other")
    assert readers.mock_corpus(spark, "fr", 5).count() == 5


def test_stream_equals_the_fold(spark, tmp_path):
    rows = [(i % 2, f"c{i % 3}", "view" if i % 4 else "practice", float(i), i, None if i % 4 else i % 8 == 0, 1.0) for i in range(60)]
    batch = events(spark, rows)
    for k in range(3):
        batch.where(f"seq % 3 >= 0 AND seq >= {k * 20} AND seq < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = tracing.traced(source).writeStream.outputMode("update").format("memory").queryName("traced").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = {(r.learner_id, r.concept_id): r.mastery for r in sorted(spark.table("traced").collect(), key=lambda r: r.events)}
    for r in learner.mastery(batch, 59.0).collect():
        end = max(x[3] for x in rows if (x[0], x[1]) == (r.learner_id, r.concept_id))
        assert tracing.decayed(last[r.learner_id, r.concept_id], (59.0 - end) / 86400) == pytest.approx(r.mastery, abs=1e-6)


# ---- model slots


def failing():
    def find(texts):
        if any("bad" in t for t in texts):
            raise ValueError("a model's error")
        return [[{"entity": w, "type": "PER"} for w in t.split() if w[0].isupper()] for t in texts]

    return find


def test_recogniser_slot(spark):
    rows = [(1, "fr", "Anna voit Paul et Anna"), (2, "fr", "  "), (3, "fr", None), (4, "fr", "bad Text"), (5, None, "Zoé")]
    docs = table(spark, rows, "doc_id int, lang string, content string")
    got = sorted((r.doc_id, r.text, r.type, r.start, r.end) for r in models.recognised(docs, failing, most_errors=1).collect())
    assert got == [(1, "Anna", "Person", 0, 4), (1, "Anna", "Person", 0, 4), (1, "Paul", "Person", 10, 14), (5, "Zoé", "Person", 0, 3)]
    with pytest.raises(Exception, match="a model's error"):
        models.recognised(docs, failing).collect()
    names = models.gazetteer_recogniser({"deep learning": "Concept", "Paris": "LOC"})
    got = sorted((r.text, r.type, r.start) for r in models.recognised(table(spark, [(1, "en", "Deep learning in PARIS, parisian")], "doc_id int, lang string, content string"), names).collect())
    assert got == [("Deep learning", "Concept", 0), ("PARIS", "Location", 17)]


def test_encoder_slot_equals_the_hashing_encoder(spark):
    docs = table(spark, [(1, "Ab.c d'e 深度学习 ab ab x_1..y"), (2, ""), (3, None), (4, "ab")], "k int, t string")
    got, want = ({r.k: r.vector for r in f.collect()} for f in (models.encoded(docs, "k", "t", models.hashing_encoder()), dense.hashed(docs, "k", "t")))
    assert all(got[k] == pytest.approx(want[k]) for k in range(1, 5)) and sum(map(abs, got[2])) == 0


@contextlib.contextmanager
def dealt_over(spark, partitions):
    """So many shuffle partitions, none of them joined, so that rows of one key that are dealt out differently don't meet."""
    names = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("sf, partitions", [("sf0.001", 1), ("sf0.001", 16), ("sf0.01", 1), ("sf0.01", 4), ("sf0.01", 16), ("sf0.1", 1), ("sf0.1", 16)])
def test_codes_find_near_vectors(spark, sf, partitions):
    d, path = catalogue.D, f"/root/testdata/{sf}"
    with dealt_over(spark, partitions):
        got = {(r.qid, r.doc_id) for r in catalogue.pq_topk(spark, path).collect() if r.qid != r.doc_id}
        want = {(r.qid, r.doc_id) for r in dense.exact(d.vectors(spark, path), d.vector_queries(spark, path), 10).collect() if r.qid != r.doc_id}
    assert len(got & want) / len(want) >= 0.9


def test_both_sides_of_cogroups_have_keys_of_one_type(spark):
    """Spark deals equal numbers of different types to different tasks."""
    d, path = catalogue.D, "/root/testdata/sf0.001"
    vectors, queries = d.vectors(spark, path), d.vector_queries(spark, path)
    cells, centres = dense.build_cells(vectors, nlist=4)
    coded, books = dense.build_codes(cells, centres)
    for df in (dense.probe_codes(coded, centres, books, queries, 3, 4), dense._in_blocks(vectors, queries, 10, 3, True, "dot")):
        plan, found = [df._jdf.queryExecution().analyzed()], 0
        while plan:
            node = plan.pop()
            plan += [node.children().apply(i) for i in range(node.children().size())]
            if "CoGroup" in node.nodeName():
                keys = [[node.children().apply(c).output().apply(i).dataType().simpleString() for i in range(n)] for c, n in enumerate((node.leftGroupingLen(), node.rightGroupingLen()))]
                assert keys[0] == keys[1]
                found += 1
        assert found == 1


# ---- search, imports, goals


def test_containing_equals_a_scan(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abé 中") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    asked = sorted({n[i : i + rng.randint(1, 7)] for n in names for i in (0, 2, 5)} | {"", "zz", "abab"})
    got = {(r.mention, r.id) for r in linking.containing(table(spark, [(a,) for a in asked], "mention string"), table(spark, list(enumerate(names)), "id int, name string")).collect()}
    assert got == {(a, i) for a in asked if a for i, n in enumerate(names) if a in n}


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoin shrdluq1中") for _ in range(rng.randint(1, 9)))
    nodes = [(f"n{i}", word(), rng.choice(["en", "fr"]), rng.choice(["C", "D"]), i) for i in range(150)]
    asked = [(word(), rng.choice(["auto", "en", None]), rng.choice([None, "C"])) for _ in range(60)]
    for t in (0.2, 0.4, 0.8, 1.0):
        got = sorted((r.mention, str(r.lang), str(r.type), r["rank"], r.id) for r in linking.fuzzy(table(spark, asked, "mention string, lang string, type string"), table(spark, nodes, "id string, name string, lang string, type string, seq int"), t, keep=("lang", "type")).collect())
        want = set()
        for m, lang, kind in asked:
            fit = [(-round(len(set(m) & set(n)) / len(set(m) | set(n)), 9), seq, i) for i, n, la, k, seq in nodes if lang in ("auto", None, la) and kind in (None, k)]
            want |= {(m, str(lang), str(kind), r, x[2]) for r, x in enumerate(sorted(x for x in fit if -x[0] >= t)[:5], 1)}
        assert got == sorted(want)


def test_upsert_settles_ties_and_imports_need_both_ends(spark):
    rows = [("a", "b", "X", 1.0, 1), ("a", "b", "X", 3.0, 2), ("a", "b", "X", 2.0, 2), ("a", "z", "X", 1.0, 3), ("b", "a", "X", None, 1)]
    edges = table(spark, rows, EDGES)
    nodes = table(spark, [("a", "A", 1), ("b", "B", 1), ("a", "A2", 2)], "id string, name string, seq int")
    n, e = graph.imported(nodes, edges)
    assert sorted((r.id, r.name) for r in n.collect()) == [("a", "A2"), ("b", "B")]
    assert sorted((r.source, r.target, r.weight) for r in e.collect()) == [("a", "b", 3.0), ("b", "a", None)]
    later, third = table(spark, [("a", "b", "X", 9.0, 5), ("c", "a", "X", 1.0, 5)], EDGES), table(spark, [("c", "C", 5)], "id string, name string, seq int")
    assert sorted((r.source, r.weight) for r in graph.imported(third, later, (n, e))[1].collect()) == [("a", 9.0), ("b", None), ("c", 1.0)]
    assert graph.imported(third, later, (n, e), clear=True)[1].count() == 0
    assert [r.id for r in graph.repeated_ids(nodes).collect()] == ["a"]


def test_cycles_of_any_length_and_difficulties(spark):
    chain = [(f"n{i}", f"n{(i + 1) % 40}", "PREREQUISITE", 1.0, i) for i in range(40)] + [("n3", "out", "PREREQUISITE", 1.0, 50), ("in", "n5", "PREREQUISITE", 1.0, 51), ("x", "x", "PREREQUISITE", 1.0, 52)]
    nodes = table(spark, [("in", "in", "en", "C", 1, "advanced"), ("n5", "n5", "en", "C", 2, "Beginner"), ("out", "out", "en", "C", 3, None)], f"{NODES}, difficulty string")
    got = {(r.rule, r.source, r.target) for r in graph.ontology_violations(nodes, table(spark, chain, EDGES)).collect()}
    assert got == {("prerequisite_cycle", a, b) for a, b, *_ in chain[:40]} | {("prerequisite_cycle", "x", "x"), ("prerequisite_harder", "in", "n5")}


def test_numbers_run_on_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), i) for i in range(500)]
    got = {(r.g, r.o): r.number for r in graph.numbered(table(spark, rows, "g string, o int").repartition(7), "g", "o").collect()}
    for g in "abc":
        assert [got[g, o] for k, o in rows if k == g] == list(range(sum(k == g for k, _ in rows)))


def goal_path_by_force(goal, needs, score, threshold=0.7, most=10):
    named = {x for pair in needs for x in pair}
    if goal not in named:
        return []
    want, queue, seen = set(), [goal], set()
    while queue:
        c = queue.pop()
        if c in seen:
            continue
        seen.add(c)
        if score.get(c, 0.0) < threshold:
            want.add(c)
            queue += [n for k, n in needs if k == c]
    out = []
    while len(out) < len(want):
        ready = [c for c in want - set(out) if all(n in out or n not in want for k, n in needs if k == c)]
        out.append(min(ready or want - set(out), key=lambda c: (score.get(c, 0.0), c)))
    return out[:most]


def test_goal_paths_equal_brute_force(spark):
    rng = random.Random(8)
    names = [f"c{i:02d}" for i in range(16)]
    needs = sorted({(names[j], names[i]) for i in range(16) for j in range(i + 1, 16) if rng.random() < 0.2})
    scores = [(u, c, round(rng.random(), 3)) for u in range(12) for c in names if rng.random() < 0.8]
    goals = [(u, rng.choice([*names, "nowhere"])) for u in range(12)]
    got = {}
    for r in learner.goal_path(table(spark, goals, "learner_id long, concept string"), table(spark, needs, "concept string, needs string"), table(spark, scores, "learner_id long, concept_id string, mastery double")).collect():
        got.setdefault(r.learner_id, []).append((r.position, r.concept_id, r.prerequisites))
    for u, goal in goals:
        want = goal_path_by_force(goal, needs, {c: s for v, c, s in scores if v == u})
        assert [c for _, c, _ in sorted(got.get(u, []))] == want
        assert all(p == sorted(n for k, n in needs if k == c) for _, c, p in got.get(u, []))


def test_documents_without_ids_stay_and_the_last_file_wins(spark, tmp_path):
    for name, rows in (("a", [{"content": "one"}, {"content": "one"}, {"doc_id": "x", "content": "old"}]), ("b", [{"content": "two", "lang": "fr"}, {"doc_id": "x", "content": "new"}, {"text": "three"}, {"doc_id": None, "content": "four"}])):
        (tmp_path / f"corpus_{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + ("\n" * 3000 if name == "a" else ""))
    got = readers.corpus(spark, readers.corpus_files(spark, str(tmp_path))).collect()
    assert sorted(r.content for r in got) == ["four", "new", "one", "one", "three", "two"] and len({r.doc_id for r in got}) == 6


def test_translation_scores_and_projection(spark):
    triples = table(spark, [("a", "X", "b", 1.0, 1)], "source string, type string, target string, weight double, seq long")
    ents = table(spark, [("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "entity string, vector array<double>")
    kinds = table(spark, [("X", [0.5, 0.0])], "type string, vector array<double>")
    assert align.translation_scores(triples, ents, kinds).first().score == pytest.approx(math.hypot(1.5, 1.0), abs=1e-8)
    assert align.translation_scores(triples, ents, kinds, [[0.0, 1.0], [1.0, 0.0]]).first().score == pytest.approx(math.hypot(2.5, 0.0), abs=1e-8)


# ---- reports and generators


def test_reports_and_generators(spark, tmp_path):
    nodes, edges = readers.mock_graph(spark)
    basic, deg, al = graph.basic_stats(nodes, edges), graph.degree_stats(nodes, edges), graph.alignment_stats(nodes, edges)
    text = sinks.graph_report(basic, deg, al, graph.weak_components(nodes, edges), graph.top_nodes(nodes, edges))
    assert "| nodes | 12 |" in text and "| edges | 17 |" in text and "| 12 nodes | 1 |" in text and "| all | 1 |" in text
    scores = table(spark, [("a", 0.5, 0.25, 1.0), ("b", 0.75, 0.2, 0.5)], "run string, ndcg double, mrr double, recall double")
    text = sinks.ablation_summary(scores, (("a", 1.0, 0.0, 0.0), ("b", 0.4, 0.6, 0.0), ("c", 0.0, 0.0, 1.0)), str(tmp_path / "s"))
    assert text.splitlines()[2:] == ["| a | 1 | - | - | 0.5000 | **0.2500** | **1.0000** |", "| b | 0.4 | 0.6 | - | **0.7500** | 0.2000 | 0.5000 |", "| c | - | - | 1 | - | - | - |"]
    assert len(json.loads(spark.read.text(str(tmp_path / "s")).first()[0])["results"]) == 2
    events_ = readers.mock_events(spark)
    found = learner.report(events_, table(spark, [("pronunciation", "alphabet")], "concept string, needs string"), 1_700_100_000.0)
    sinks.json_report(found, str(tmp_path / "r"))
    back = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert len(back) == 3 and all(r["concepts"] == len(readers.MOCK_LEARNER) for r in back)
    batches = readers.mock_entities(spark, "fr")
    assert batches.count() == 20 and graph.nodes(graph.mentions_of(batches)).count() == len(readers.MOCK_CONCEPTS)
    assert readers.mock_relations(spark, "fr").where("head = tail").count() == 0
    ents, rels, triples = align.entity_table(nodes, edges.union(table(spark, [("concept_grammar_fr", "nowhere", "OTHER", 1.0, 99)], EDGES)))
    assert (ents.count(), sorted(r.type for r in rels.collect()), triples.count()) == (12, ["ALIGNED_WITH", "OTHER", "PREREQUISITE"], 17)
    both = align.trained(edges, dim=8, epochs=2, parts=True)
    sinks.model(both.where("kind = 'entity'").select(F.col("name").alias("entity"), "vector"), both.where("kind = 'relation'").select(F.col("name").alias("type"), "vector"), str(tmp_path / "m"))
    e, r = readers.model(spark, str(tmp_path / "m"))
    assert (e.count(), r.count()) == (12, 2) and align.translation_scores(edges, e, r).count() == 17


def test_fused_runs_have_each_document_once(spark):
    """Two runs that are dealt out by query, and a third that is empty: Spark 4.1 would group their union without an exchange."""
    d, path = catalogue.D, "/root/testdata/sf0.01"
    found = search.runs(d.questions(spark, path), d.corpus(spark, path))
    fused = fusion.fuse(fusion.components(found["dense"], found["sparse"], found["sparse"].limit(0)), by=(0.4, 0.3, 0.0), k=100)
    scores = metrics.compare({"full": fused, "sparse": found["sparse"]}, catalogue.contains_qrels(spark, path)).collect()
    assert all(0 <= r["map"] <= 1 for r in scores) and fused.groupBy("qid", "doc_id").count().where("count > 1").isEmpty()
