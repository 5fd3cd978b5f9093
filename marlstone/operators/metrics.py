"""Retrieval metrics over runs (qid, doc_id, rank) and relevance judgements (qid, doc_id, rel)."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.lineage import kept


def per_query(run: DataFrame, qrels: DataFrame, ndcg_k: int = 10, recall_k: int = 50, precision_k: int = 10, grades: DataFrame | None = None) -> DataFrame:
    """(qid, ndcg, mrr, recall, precision, ap) of each query that is in the run and in the judgements.

    The judgements of a query are reduced to counts by grade, before a shuffle, and hits are joined once for all metrics. Where
    judgements are too many to be listed, grades gives these counts (qid, rel, n), and qrels only those of what is in the run."""
    gain = lambda rel: F.pow(F.lit(2.0), rel) - 1
    discount = lambda rank: F.log2(rank + 1.0)
    grades = qrels.groupBy("qid", "rel").agg(F.count("*").alias("n")) if grades is None else grades
    upto = F.sum("n").over(W.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(W.unboundedPreceding, W.currentRow))
    sums_of = F.array(*[F.lit(x) for x in accumulate((1 / math.log2(i + 1) for i in range(1, ndcg_k + 1)), initial=0.0)])  # of the first 0, 1, ... discounts
    discounts = lambda i: F.get(sums_of, F.least(i, F.lit(ndcg_k)).cast("int"))
    ideal = grades.withColumn("upto", upto).groupBy("qid").agg(
        F.sum(gain(F.col("rel")) * (discounts(F.col("upto")) - discounts(F.col("upto") - F.col("n")))).alias("idcg"),
        F.coalesce(F.sum(F.when(F.col("rel") > 0, F.col("n"))), F.lit(0)).alias("relevant"),
    )
    hits = run.join(qrels, ["qid", "doc_id"], "left").select("qid", "doc_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    hit = (F.col("rel") > 0).cast("int")
    so_far = F.sum(hit).over(W.partitionBy("qid").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    first_seen = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy("rank")) == 1
    hits = hits.withColumns({"so_far": so_far, "fresh": first_seen})
    new_hit = (F.col("rel") > 0) & F.col("fresh")
    sums = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= ndcg_k, gain(F.col("rel")) / discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.max(F.when(F.col("rel") > 0, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.count_if(new_hit & (F.col("rank") <= recall_k)).alias("in_recall"),
        F.count_if(new_hit & (F.col("rank") <= precision_k)).alias("in_precision"),
        F.sum(F.when(F.col("rel") > 0, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    precision = F.col("in_precision") / precision_k if precision_k else F.lit(0.0)
    return sums.join(ideal, "qid").select("qid", share("dcg", "idcg").alias("ndcg"), "mrr", share("in_recall", "relevant").alias("recall"), precision.alias("precision"), share("precisions", "relevant").alias("ap"))


def summary(scores: DataFrame, queries: DataFrame | None = None, names: tuple[str, ...] = ("ndcg@10", "mrr", "recall@50", "precision@10", "map")) -> DataFrame:
    """(metric, value): means over the evaluated queries; with queries given, those that are absent from the run count as 0."""
    columns = ("ndcg", "mrr", "recall", "precision", "ap")
    if queries is not None:
        scores = queries.select("qid").join(scores, "qid", "left").fillna(0.0, list(columns))
    means = scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])
    pairs: list[Column] = [F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in zip(names, columns)]
    return means.select(F.explode(F.array(*pairs)).alias("m")).select("m.metric", "m.value")


def compare(runs: dict[str, DataFrame], qrels: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """A row for each run, a column for each metric; grades as for per_query."""
    out, qrels = None, kept(qrels)  # each run reads them twice
    for name, run in runs.items():
        row = summary(per_query(run, qrels, grades=grades)).withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("run").pivot("metric", ["map", "mrr", "ndcg@10", "precision@10", "recall@50"]).agg(F.first("value")).fillna(0.0)
