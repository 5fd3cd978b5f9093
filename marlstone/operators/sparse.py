"""BM25 over several fields, and document look-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import top, words
from marlstone.functions.lineage import kept
from marlstone.operators import dense

#: Bytes of query terms that are sent to all tasks, documents whose words are counted at once, pairs of a posting and a query that are summed at once.
SHIPPED, ROWS, PAIRS = 16 << 20, 1024, 1 << 20


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): distinct terms of each query; a blank query has none."""
    return queries.select("qid", F.explode(F.array_distinct(words(F.coalesce(F.col("query"), F.lit(""))))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = config.TOP_K, fields: tuple[str, ...] = ("title", "content"), lang: str | None = None, scores_only: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank): the sum over fields and query terms, best k for each query.

    Documents are read and tokenised once. Terms of up to SHIPPED bytes, which is measured, go to all tasks; a document's counts of
    them are kept in its row, and each task keeps the k best of each query, so that no postings are shuffled. Else, and for all
    scores, postings are joined: one row with an empty term gives numbers and mean lengths of fields."""
    docs = docs if lang is None else docs.where(F.col("lang") == lang)
    terms = query_terms(queries)
    asked = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("bytes"), F.count_distinct("qid").alias("queries")).first()
    if scores_only or asked["bytes"] > SHIPPED or asked["queries"] * k > dense.HELD:
        scored = _joined(docs, terms, fields)
        return scored if scores_only else top(scored, ["qid"], [F.desc("score"), F.col("doc_id")], k)
    return top(_shipped(docs, terms, k, fields), ["qid"], [F.desc("score"), F.col("doc_id")], k)


def _shipped(docs: DataFrame, terms: DataFrame, k: int, fields: tuple[str, ...]) -> DataFrame:
    """(qid, doc_id, score): each task's k best of each query. Terms go to all tasks, documents stay where they are."""
    kinds = terms.schema["qid"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    pairs = terms.toArrow()  # SHIPPED bounds it
    of_query, of_term = (dense.one_array(pairs, c).dictionary_encode(null_encoding="encode") for c in ("qid", "term"))
    names, wanted = of_query.dictionary, of_term.dictionary
    order = np.argsort(of_term.indices.to_numpy(), kind="stable")
    asking = of_query.indices.to_numpy()[order].astype(np.int64)  # the queries of each term, one term after the other
    ends = np.cumsum(np.bincount(of_term.indices.to_numpy(), minlength=len(wanted)))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(wanted)
    held = _merged(kept(_counted(docs, sent, fields, kinds[1])))
    lens = held.select(F.explode("sizes").alias("s")).groupBy("s.field").agg(F.avg("s.len").alias("avg_len"), F.count("*").alias("n")).collect()  # a row a field
    average, n = np.ones(len(fields)), np.zeros(len(fields))
    for r in lens:
        average[r["field"]], n[r["field"]] = r["avg_len"] or 1.0, r["n"]
    df = held.select(F.explode("hits").alias("h")).groupBy("h.field", "h.term").agg(F.count("*").alias("df")).toArrow()  # a row a field and wanted term
    idf = np.zeros((len(fields), len(wanted)))
    field, term, count = (df.column(c).to_numpy() for c in ("field", "term", "df"))
    idf[field, term] = np.log(n[field] / (count + 1)) + 1
    table = context.broadcast((names, asking, ends, idf, average))
    k1, b = config.BM25_K1, config.BM25_B

    def run(batches):
        names, asking, ends, idf, average = table.value
        starts, best = np.concatenate([[0], ends[:-1]]), dense.Best(len(names), k)
        for batch in batches:
            hits = batch.column("hits")
            at = hits.offsets.to_numpy()
            at = at - at[0]
            field, term, tf, size = (x.to_numpy() for x in hits.flatten().flatten())
            part = idf[field, term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average[field]))
            uses = (ends - starts)[term]
            upto = np.concatenate([[0], np.cumsum(uses)])[at]  # pairs of a hit and a query before each document
            low = 0
            while low < batch.num_rows:  # documents of about PAIRS pairs and SCORES scores at most
                high = int(np.searchsorted(upto, upto[low] + PAIRS, "right")) - 1
                high = min(max(high, low + 1), low + max(1, dense.SCORES // max(1, len(names))), batch.num_rows)
                of = slice(at[low], at[high])
                n = uses[of]
                place = np.repeat(starts[term[of]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                doc = np.repeat(np.repeat(np.arange(high - low), np.diff(at[low : high + 1])), n)
                score = np.bincount(asking[place] * (high - low) + doc, np.repeat(part[of], n), len(names) * (high - low)).reshape(len(names), high - low)
                some = score > 0
                score = np.round(score, 9)
                rows, columns = np.nonzero(some & (score >= best.floor[:, None]))
                best.add(rows, score[rows, columns], batch.column("doc_id").take(pa.array(columns + low)))
                low = high
        yield from best.batches(names)

    return held.select("doc_id", "hits").mapInArrow(run, f"qid {kinds[0]}, doc_id {kinds[1]}, score double")


def _counted(docs: DataFrame, wanted, fields: tuple[str, ...], kind: str) -> DataFrame:
    """(doc_id, sizes, hits) of each document: its fields' lengths, and its counts of wanted terms. Words are counted in the row, without a shuffle."""

    def run(batches):
        for batch in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            made, of = [], []
            for i in range(len(fields)):
                lists = batch.column(i + 1)
                n = np.diff(lists.offsets.to_numpy())
                code = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted.value), -1).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), n)
                seen = np.flatnonzero(code >= 0)
                key, tf = np.unique(row[seen] * len(wanted.value) + code[seen], return_counts=True)
                made.append(np.stack([key // max(1, len(wanted.value)), np.full(len(key), i), key % max(1, len(wanted.value)), tf, n[key // max(1, len(wanted.value))]]))
                of.append(n)
            row, field, term, tf, size = np.concatenate(made, axis=1)
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            number = lambda x: pa.array(x, pa.int32())
            hits = pa.StructArray.from_arrays([number(x[order]) for x in (field, term, tf, size)], ["field", "term", "tf", "len"])
            sizes = pa.StructArray.from_arrays([number(np.tile(np.arange(len(fields)), batch.num_rows)), number(np.stack(of, 1).ravel())], ["field", "len"])
            steps = number(np.arange(0, len(fields) * batch.num_rows + 1, len(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(steps, sizes), pa.ListArray.from_arrays(number(ends), hits)], names=["doc_id", "sizes", "hits"])

    texts = docs.select("doc_id", *[words(F.coalesce(F.col(f), F.lit(""))).alias(f"__{i}") for i, f in enumerate(fields)])
    return texts.mapInArrow(run, f"doc_id {kind}, sizes array<struct<field:int,len:int>>, hits array<struct<field:int,term:int,tf:int,len:int>>")


def _merged(counted: DataFrame) -> DataFrame:
    """counted with one row for an id that several documents have: texts of one length are one text."""
    repeated = kept(counted.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")))
    if repeated.isEmpty():
        return counted
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    many = counted.join(repeated, same, "left_semi")
    sizes = many.select("doc_id", F.explode("sizes").alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("sizes"))
    hits = many.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", "h.field", "h.term", "h.len").agg(F.sum("h.tf").cast("int").alias("tf"))
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("field", "term", "tf", "len")).alias("hits"))
    both = sizes.alias("s").join(hits.alias("h"), F.col("s.doc_id").eqNullSafe(F.col("h.doc_id")), "left")
    both = both.select("s.doc_id", "s.sizes", F.coalesce("h.hits", F.array().cast(counted.schema["hits"].dataType)).alias("hits"))
    return kept(counted.join(repeated, same, "left_anti").unionByName(both))


def _joined(docs: DataFrame, terms: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(qid, doc_id, score) of all pairs, for more terms than are sent to tasks."""
    wanted = terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in fields]))
    held = docs.select("doc_id", parts.alias("t")).select("doc_id", "t.field", F.size("t.w").alias("len"), F.explode(F.concat("t.w", F.array(F.lit("")))).alias("term"))
    found = kept(held.join(wanted, "term", "left_semi").groupBy("field", "term", "doc_id", "len").agg(F.count("*").alias("tf")))
    sizes = found.where("term = ''").groupBy("field").agg(F.avg("len").alias("avg_len"), F.count("*").alias("n"))
    tf = found.where("term <> ''")
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    weights = df.join(sizes, "field").select("field", "term", "avg_len", (F.log(F.col("n") / (F.col("df") + 1)) + 1).alias("idf"))
    k1, b = config.BM25_K1, config.BM25_B
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = tf.join(weights, ["field", "term"]).select("term", "doc_id", part.alias("part")).join(terms, "term")
    scored = scored.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return scored


def lookup(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of the given ids, their concepts as a list."""
    return docs.join(ids, "doc_id", "left_semi")
