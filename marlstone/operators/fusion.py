"""Fusion of dense, sparse and graph scores, with explanations, and the ablation over weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import top
from marlstone.functions.session import plain_unions

SOURCES = ("dense", "sparse", "kg")
METHODS = ("weighted_sum", "rrf", "max")


def weights(alpha: float, beta: float, gamma: float) -> tuple[float, float, float]:
    """Divided by their sum if it is more than 0.01 from 1."""
    total = alpha + beta + gamma
    return (alpha / total, beta / total, gamma / total) if abs(total - 1) > 0.01 else (alpha, beta, gamma)


def components(dense: DataFrame, sparse: DataFrame, kg: DataFrame) -> DataFrame:
    """(qid, doc_id, source, score, rank) of the three runs in one table."""
    plain_unions(dense.sparkSession)
    out = None
    for name, run in zip(SOURCES, (dense, sparse, kg)):
        part = run.select("qid", "doc_id", F.lit(name).alias("source"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def normalised(parts: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within query and source; where they are all equal, 1."""
    span = W.partitionBy("qid", "source")
    low, high = F.min("score").over(span), F.max("score").over(span)
    return parts.withColumn("norm", F.when(high - low < 1e-6, 1.0).otherwise((F.col("score") - low) / (high - low)))


def pivoted(parts: DataFrame, value: str) -> DataFrame:
    """(qid, doc_id, dense, sparse, kg): one shuffle in place of two outer joins."""
    return parts.groupBy("qid", "doc_id").agg(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col(value))), F.lit(0.0)).alias(s) for s in SOURCES])


def fuse(parts: DataFrame, method: str = "weighted_sum", by: tuple[float, float, float] = config.FUSION_WEIGHTS, k: int | None = None) -> DataFrame:
    """(qid, doc_id, fused_score, dense, sparse, kg, rank); the components are normalised, for "rrf" reciprocal ranks."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    a, b, c = weights(*by)
    if method == "rrf":
        wide = pivoted(parts.withColumn("r", 1.0 / (config.RRF_K + F.col("rank"))), "r")
    else:
        wide = pivoted(normalised(parts), "norm")
    terms = [F.col(s) * w for s, w in zip(SOURCES, (a, b, c))]
    score = F.greatest(*terms) if method == "max" else terms[0] + terms[1] + terms[2]
    scored = wide.withColumn("fused_score", F.round(score, 9))
    return top(scored, ["qid"], [F.desc("fused_score"), F.col("doc_id")], k or 2**31 - 1)


def explained(fused: DataFrame, by: tuple[float, float, float] = config.FUSION_WEIGHTS) -> DataFrame:
    """A row for each source of a fused result: score, weight, contribution."""
    parts = [F.struct(F.lit(s).alias("source"), F.col(s).alias("score"), F.lit(w).alias("weight"), (F.col(s) * w).alias("contribution")) for s, w in zip(SOURCES, weights(*by))]
    return fused.select("qid", "doc_id", "rank", F.explode(F.array(*parts)).alias("p")).select("qid", "doc_id", "rank", "p.source", "p.score", "p.weight", "p.contribution")


def enriched(fused: DataFrame, docs: DataFrame) -> DataFrame:
    return fused.join(docs.select("doc_id", "title", "lang"), "doc_id", "left")


def ablation(parts: DataFrame, k: int = 100) -> DataFrame:
    """(run, qid, doc_id, rank) of the seven weight triples in one job: the table of triples has a fixed size, and a source of weight 0 gives no candidates."""
    spark = parts.sparkSession
    triples = spark.createDataFrame(list(config.ABLATION), "run string, wd double, ws double, wk double")
    own = F.when(F.col("source") == "dense", F.col("wd")).when(F.col("source") == "sparse", F.col("ws")).otherwise(F.col("wk"))
    each = normalised(parts).join(F.broadcast(triples)).withColumn("w", own).where("w > 0")
    scored = each.groupBy("run", "qid", "doc_id").agg(F.round(F.sum(F.col("norm") * F.col("w")), 9).alias("score"))
    return top(scored, ["run", "qid"], [F.desc("score"), F.col("doc_id")], k)
