"""What tasks hold and what is shuffled stays bounded as tables grow."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dense, expand, inverted, sparse
from marlstone.plans import catalogue
from marlstone.plans import domain as D

SF = "/root/testdata/sf0.001"


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_task_holds_few_products():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(6000, 8)), rng.normal(size=(4000, 8))
    tracemalloc.start()
    rows, columns, score = dense.scored(x, y, 5, "dot", None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all products take 192 MB
    some = np.argsort(-np.round(x[77] @ y.T, 9))[:5]
    assert set(columns[rows == 77]) == set(some) and len(rows) == 30_000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_copies_are_cut_in_the_task(spark, kind):
    vectors = spark.range(0, 3000, 1, 2).select(F.col("id").cast(kind).alias("doc_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    queries = vectors.where("doc_id IN (5, 2000)").withColumnRenamed("doc_id", "qid")
    assert dense._shipped(vectors, queries, 2, 4, False, "dot").count() == 2 * 2 * 4  # tasks, queries, k; before 5,998
    first = sorted(map(str, range(3000))) if kind == "string" else list(range(3000))
    for shipped in (True, False):
        met = dense._shipped if shipped else dense._in_blocks
        found = dense.top(met(vectors, queries, 2, 4, False, "dot"), ["qid"], [F.desc("score"), F.col("doc_id")], 4)
        for q in (5, 2000):
            of = str(q) if kind == "string" else q
            assert [r.doc_id for r in found.where(F.col("qid") == of).orderBy("rank").collect()] == [i for i in first if i != of][:4]


def test_many_results_arent_held_by_each_task(spark, monkeypatch):
    monkeypatch.setattr(dense, "HELD", 10)
    monkeypatch.setattr(dense, "_shipped", None)
    vectors = D.vectors(spark, SF)
    assert dense.exact(vectors, D.vector_queries(spark, SF), 5).count() == 5 * D.vector_queries(spark, SF).count()


def test_judgements_are_counted_without_listing_them(spark):
    run = catalogue.dense_run(spark, SF)
    every = D.vector_qrels(spark, SF)
    assert as_set(D.vector_judged(spark, SF, run), "qid", "doc_id", "rel") == as_set(every.join(run, ["qid", "doc_id"], "left_semi"), "qid", "doc_id", "rel")
    assert as_set(D.vector_grades(spark, SF), "qid", "rel", "n") == as_set(every.groupBy("qid", "rel").agg(F.count("*").alias("n")), "qid", "rel", "n")


def test_cells_meet_queries_in_blocks(spark, monkeypatch):
    cells, centres = dense.build_cells(D.vectors(spark, SF), nlist=4)
    near = dense.nearest_cells(centres, D.vector_queries(spark, SF), 3).select("qid", "vector", "cell")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "BLOCK", 16)
    left, right = dense.spread(near, cells, 16)
    size = lambda df: df.groupBy("cell", "part", "block").count().agg(F.max("count")).first()[0]
    assert size(left) <= 12 and size(right) <= 40
    found = dense.probe(cells, centres, D.vector_queries(spark, SF), 10, 3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().analyzed().toString()  # not a row for each pair in the JVM
    asked = near.join(cells.withColumnRenamed("vector", "v"), "cell").select("qid", "doc_id", F.round(dense_dot(), 9).alias("score"))
    want = dense.top(asked, ["qid"], [F.desc("score"), F.col("doc_id")], 10)
    assert as_set(found, "qid", "rank", "doc_id") == as_set(want, "qid", "rank", "doc_id")


def dense_dot():
    from marlstone.functions.columns import dot

    return dot(F.col("vector"), F.col("v"))


def test_codes_meet_queries_in_blocks(spark, monkeypatch):
    cells, centres = dense.build_cells(D.vectors(spark, SF), nlist=4)
    coded, books = dense.build_codes(cells, centres)
    queries = D.vector_queries(spark, SF)
    whole = as_set(dense.probe_codes(coded, centres, books, queries, 5, 3), "qid", "rank", "doc_id")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    found = dense.probe_codes(coded, centres, books, queries, 5, 3)
    assert "block" in found._jdf.queryExecution().analyzed().toString()
    assert as_set(found, "qid", "rank", "doc_id") == whole


DOCS = [(1, "a b", "x y x"), (1, "b", "z z y"), (1, "c d", "x"), (None, "x", "y"), (None, "x y", "q"), (4, None, None), (5, "x", "y z x y"), (6, "", "x y z w"), (7, "x", "y z x y")]


@pytest.mark.parametrize("ids", ["all", "single"])
def test_bm25_without_shuffling_postings(spark, monkeypatch, ids):
    rows = [r for r in DOCS if ids == "all" or (r[0] or 0) > 3]
    docs = spark.createDataFrame(rows, "doc_id int, title string, content string").repartition(3)
    queries = spark.createDataFrame([("q", "x y"), ("r", "z absent"), (None, "w"), ("q", "y"), ("s", "")], "qid string, query string")
    monkeypatch.setattr(sparse, "PAIRS", 3)
    joined = sparse._joined
    monkeypatch.setattr(sparse, "_joined", None)
    for k in (1, 2, 10):
        found = as_set(sparse.bm25(docs, queries, k), F.coalesce("qid", F.lit("-")), F.coalesce("doc_id", F.lit(0)), "rank", "score")
        every = joined(docs, sparse.query_terms(queries), ("title", "content"))
        want = as_set(dense.top(every, ["qid"], [F.desc("score"), F.col("doc_id")], k), F.coalesce("qid", F.lit("-")), F.coalesce("doc_id", F.lit(0)), "rank", "score")
        assert [r[:3] for r in found] == [r[:3] for r in want]
        assert [r[3] for r in found] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_bm25_joins_terms_that_are_too_many(spark, monkeypatch):
    docs, queries = D.corpus(spark, SF), D.questions(spark, SF)
    want = as_set(sparse.bm25(docs, queries, 3), "qid", "rank", "doc_id")
    monkeypatch.setattr(sparse, "SHIPPED", 10)
    monkeypatch.setattr(sparse, "_shipped", None)
    assert as_set(sparse.bm25(docs, queries, 3), "qid", "rank", "doc_id") == want


def test_graph_run_takes_the_first_documents_of_concepts(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(int(i), [f"c{j}" for j in rng.choice(6, rng.integers(0, 4), replace=False)]) for i in rng.permutation(60)], "doc_id int, concepts array<string>")
    scores = spark.createDataFrame([(f"s{s}", f"c{c}", float(rng.integers(0, 3)) / 2) for s in range(4) for c in range(6)], "seed string, id string, score double")
    want = dense.top(expand.document_scores(scores, docs), ["qid"], [F.desc("score"), F.col("doc_id")], 7)
    found = expand.document_run(scores, docs, 7)
    assert as_set(found, "qid", "rank", "doc_id", "score") == as_set(want, "qid", "rank", "doc_id", "score")


def test_blocks_of_an_append_shuffle_no_postings(spark, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 16)
    docs = D.corpus(spark, SF).select("doc_id", F.col("lang").alias("kind"), *[dense.words(F.col(c)).alias(f"__{i}") for i, c in enumerate(("title", "content"))])
    blocks = inverted._blocks(inverted._windows(docs, "doc_id"), ("title", "content"))
    assert "hashpartitioning" not in blocks._jdf.queryExecution().executedPlan().toString()
    every = docs.select("doc_id", F.explode("__1").alias("term")).groupBy("doc_id", "term").count()
    found = blocks.where("field = 'content' AND term <> ''").select("term", F.explode("postings").alias("p")).select("p.doc_id", "term", F.col("p.tf").cast("long").alias("count"))
    assert as_set(found, "doc_id", "term", "count") == as_set(every, "doc_id", "term", "count")
    sums = blocks.select(F.size("postings") == F.col("n"), F.array_max("postings.tf") == F.col("max_tf"), F.array_min("postings.len") == F.col("min_len")).distinct().collect()
    assert [tuple(r) for r in sums] == [(True, True, True)]


def plans_of(monkeypatch) -> list[str]:
    plans, added = [], inverted.Index._added
    monkeypatch.setattr(inverted.Index, "_added", lambda self, blocks, old: plans.append(blocks._jdf.queryExecution().executedPlan().toString()) or added(self, blocks, old))
    return plans


def test_a_merge_shuffles_blocks_once_and_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 8)
    plans, docs = plans_of(monkeypatch), D.corpus(spark, SF)
    index = inverted.Index(spark, str(tmp_path))
    index.append(docs.where("doc_id % 2 = 0"))
    index.append(docs.where("doc_id % 2 = 1"))
    index.merge()
    assert plans[2].count("Exchange") == 1 and "hashpartitioning(bucket" in plans[2]
    assert all("regexp_extract_all" not in p.partition("Exchange rangepartitioning")[2] for p in plans[:2])  # texts are shuffled, not their words
    found = index.blocks().where("term = '' AND field = 'content'").select("kind", "window", F.explode("postings").alias("p")).select("kind", "window", "p.*")
    windows = found.groupBy("kind", "window").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high")).orderBy("kind", "low", "high").collect()
    assert found.count() == docs.count() and max(r.n for r in windows) <= 8
    assert all(a.high <= b.low for a, b in zip(windows, windows[1:]) if a.kind == b.kind)  # windows over all documents


def test_a_search_keeps_the_best_of_a_window(spark, tmp_path, monkeypatch):
    index = inverted.Index(spark, str(tmp_path))
    index.append(D.corpus(spark, SF))
    queries, sizes, kept = D.questions(spark, SF), [], inverted.kept

    def counted(df):
        out = kept(df)
        if "score" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(inverted, "kept", counted)
    index.search(queries, 2)
    assert sizes and max(sizes) <= queries.count() * inverted.PROBES * 2  # before, all documents of the windows
