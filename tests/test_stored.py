"""Stored indexes: versions, the inverted index, the vector index."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.functions.versions import Versions
from marlstone.operators import dense, inverted, sparse, vectorindex
from marlstone.plans import catalogue
from marlstone.plans import domain as D
from marlstone.sources import keyed

SF = "/root/testdata/sf0.001"
DOCS = "doc_id int, lang string, title string, content string"
CORPUS = [
    (1, "en", "Deep learning", "learning deep nets and more nets"), (2, "en", None, "nets of fish"), (3, None, "nets", None), (4, "fr", "", ""),
    (5, "fr", "réseaux", "deep deep réseaux nets"), (6, "en", "deep", "deep " * 50), (7, "zh", "深度学习", "深度学习 nets"),
]


def run_of(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, query string")


# versions


def test_a_version_counts_once_it_is_written(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/t")
    assert versions.current() == (0, {})
    assert versions.commit(0, {"parts": ["a", "é"]}) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        versions.commit(0, {"parts": ["b"]})
    assert versions.current() == (1, {"parts": ["a", "é"]})
    for name in ("a", "b"):
        os.makedirs(tmp_path / "t" / "parts" / name)
    assert versions.swept("parts", ["a"]) == 1 and os.listdir(tmp_path / "t" / "parts") == ["a"]


# inverted index


def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "WINDOW", 2)  # so that there are windows to leave out
    queries = asked(spark, "deep nets", "réseaux", "absent", "", None, "深度学习", "nets nets of")
    index = inverted.Index(spark, str(tmp_path))
    assert index.search(queries).collect() == []
    docs = spark.createDataFrame(CORPUS, DOCS)
    index.append(docs.where("doc_id < 4"))
    assert run_of(index.search(queries, 2)) == run_of(sparse.bm25(docs.where("doc_id < 4"), queries, 2))
    index.append(docs.where("doc_id >= 4"))
    index.append(docs.where("false"))
    for k in (1, 3, 10):
        assert run_of(index.search(queries, k)) == run_of(sparse.bm25(docs, queries, k))
    assert run_of(index.search(queries, lang="en")) == run_of(sparse.bm25(docs, queries, lang="en"))
    index.merge()
    assert len(index.segments()) == 1 and index.sweep() == 3
    assert run_of(index.search(queries, 3)) == run_of(sparse.bm25(docs, queries, 3))
    index.append(spark.createDataFrame([(8, "en", "late", "deep nets late")], DOCS))
    assert 8 in {r.doc_id for r in index.search(asked(spark, "late")).collect()}


def test_index_leaves_windows_out_and_reads_no_documents(spark, tmp_path):
    index = catalogue.stored_index(spark, "/root/testdata/sf0.01", str(tmp_path))
    found, work = index.explained(D.questions(spark, "/root/testdata/sf0.01"))
    windows, scored = work.agg(F.sum("windows"), F.sum("scored")).first()
    assert 0 < scored < windows / 2
    assert run_of(found) == run_of(sparse.bm25(D.corpus(spark, "/root/testdata/sf0.01"), D.questions(spark, "/root/testdata/sf0.01")))
    assert not any("documents.parquet" in f for f in index.blocks().inputFiles())
    plan = index._of(index.blocks(), asked(spark, "the").select(F.col("query").alias("term"))).select("n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket), ", "") or "bucket" in plan.partition("PartitionFilters")[2][:120]
    assert "postings" not in plan


def test_an_append_that_fails_leaves_the_old_index(spark, tmp_path):
    index = inverted.Index(spark, str(tmp_path))
    docs = spark.createDataFrame(CORPUS, DOCS)
    index.append(docs)
    before = run_of(index.search(asked(spark, "deep nets")))
    broken = docs.withColumn("content", F.raise_error(F.lit("no disk")).cast("string"))
    with pytest.raises(Exception, match="no disk"):
        index.append(broken)
    assert run_of(index.search(asked(spark, "deep nets"))) == before


# vector index


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_vector_index_finds_near_vectors(spark, tmp_path, sf):
    path = f"/root/testdata/{sf}"
    vectors, queries = D.vectors(spark, path).select("doc_id", "vector"), D.vector_queries(spark, path).select("qid", "vector")
    index = catalogue.stored_vectors(spark, path, str(tmp_path))
    assert sorted(r.doc_id for r in index.rows().select("doc_id").collect()) == sorted(r.doc_id for r in vectors.select("doc_id").collect())
    got = {(r.qid, r.doc_id) for r in index.search(queries).collect() if r.qid != r.doc_id}
    want = {(r.qid, r.doc_id) for r in dense.exact(vectors, queries, 10).collect() if r.qid != r.doc_id}
    assert len(got & want) / len(want) >= 0.9


def test_a_search_of_all_cells_is_exact_and_of_some_reads_their_files(spark, tmp_path):
    vectors, queries = D.vectors(spark, SF).select("doc_id", "vector"), D.vector_queries(spark, SF).select("qid", "vector")
    index = vectorindex.VectorIndex(spark, str(tmp_path))
    index.build(vectors.where("doc_id % 5 <> 0"), nlist=8)
    index.insert(vectors.where("doc_id % 5 = 0"))
    index.insert(vectors.where("false"))
    models = index.versions.current()[1]["codes"]
    split = index.split(40)
    now = index.versions.current()[1]
    assert split and now["codes"] == models  # nothing was fitted again
    sizes = {r.cell: r["count"] for r in index.rows().groupBy("cell").count().collect()}
    assert not set(split) & set(sizes) and sum(sizes.values()) == vectors.count() and len(sizes) == index.centres().count()
    kept = [p for p in os.listdir(tmp_path / "parts") if p != now["parts"][-1]["name"]]
    assert {c for c in os.listdir(tmp_path / "parts" / now["parts"][-1]["name"]) if c.startswith("cell=")} == {f"cell={c}" for c in sizes if c >= 8} and kept
    assert run_of(index.search(queries, 5, nprobe=100, refine=100)) == run_of(dense.exact(vectors, queries, 5))
    index.sweep()
    assert run_of(index.search(queries, 5, nprobe=100, refine=100)) == run_of(dense.exact(vectors, queries, 5))
    one = queries.where("qid = 20")
    probed = {r.cell for r in dense.nearest_cells(index.centres(), one, 3).collect()}
    rows = index._probed(one, 3)
    assert len(probed) == 3 and {r[0].split("cell=")[1].split("/")[0] for r in rows.select(F.input_file_name()).distinct().collect()} == {str(c) for c in probed}
    scan = rows.select("doc_id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "cell" in scan.partition("PartitionFilters")[2][:80] and "vector" not in scan


def test_rotation_is_orthogonal_and_brings_codes_nearer(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(600, 8)) * [8, 6, 1, 1, 0.5, 0.2, 0.1, 0.1] @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    rows = spark.createDataFrame([(x.tolist(), [0.0] * 8) for x in mixed], "vector array<double>, centre array<double>")
    errors = []
    for turns in (0, 8):
        books, rotation = dense.fit_codes(rows, 4, 3, 1, turns)
        assert np.allclose(rotation @ rotation.T, np.eye(8))
        turned = mixed @ rotation
        codes = dense.parts_of(turned, books)
        errors.append(((turned - np.concatenate([books[i][codes[:, i]] for i in range(4)], axis=1)) ** 2).sum())
    assert errors[1] < 0.9 * errors[0]


# keyed table


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merges_write_the_ranges_that_they_touch(spark, tmp_path):
    make = lambda first, end, tag: spark.range(first, end).select(F.format_string("k%06d", "id").alias("id"), F.lit(tag).alias("tag"), F.col("id").alias("n"))
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t")
    table.create(make(0, 20_000, "old"), file_rows=200)
    now = table.versions.current()[1]
    assert 80 <= len(now["files"]) <= 120
    touched = table.merge(make(5000, 5200, "new"))  # one hundredth
    assert len(touched) <= 3
    after = table.versions.current()[1]["files"]
    assert sum(after[r] != p for r, p in now["files"].items()) == len(touched)
    assert rows_of(table.read()) == rows_of(make(0, 5000, "old").union(make(5000, 5200, "new")).union(make(5200, 20_000, "old")))
    assert len(table.delete(make(5000, 5100, "").select("id"))) <= 2 and table.read().count() == 19_900
    assert table.sweep() >= len(touched) and table.read().count() == 19_900
    assert table.merge(make(0, 0, "x")) == []


def test_keys_are_unique_and_a_failed_merge_changes_nothing(spark, tmp_path):
    kinds = "a string, b int, v string, seq int"
    of = lambda *rows: spark.createDataFrame(list(rows), kinds)
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ("a", "b"))
    table.create(of(("x", 1, "one", 1), ("x", 1, "two", 3), ("x", 1, "three", 2), (None, 1, "null", 1), ("", 1, "empty", 1), ("x\x01=1", None, "odd", 1)), "seq")
    held = [("", 1, "empty", 1), ("x", 1, "two", 3), ("x\x01=1", None, "odd", 1), (None, 1, "null", 1)]
    assert rows_of(table.read()) == sorted(held, key=str)
    for rows in (of(("x", 1, "again", 9)), of(("n", 1, "a", 1), ("n", 1, "b", 2))):
        with pytest.raises(ValueError, match="there already"):
            table.insert(rows)
    with pytest.raises(Exception, match="no disk"):
        table.merge(of(("x", 1, "z", 9)).withColumn("v", F.raise_error(F.lit("no disk")).cast("string")))
    assert rows_of(table.read()) == sorted(held, key=str)
    table.insert(of(("n", None, "a", 1)))
    table.merge(of(("n", None, "b", 1), ("n", None, "a", 1)))  # a tie goes by the other columns
    assert rows_of(table.read()) == sorted([*held, ("n", None, "b", 1)], key=str)
    table.create(of())
    assert table.read().count() == 0 and table.merge(of(("q", 1, "v", 1))) == [0] and table.read().count() == 1
