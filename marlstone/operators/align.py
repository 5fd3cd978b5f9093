"""Translation embeddings of entities: training, scores, nearest entities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import dot, l2
from marlstone.operators.dense import exact
from marlstone.operators.graph import numbered


def encoded(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity ids, relation ids, triples as h, r, t): ids number the names in their order."""
    ranked = lambda names: numbered(names.distinct().withColumn("__all", F.lit(0)), "__all", "name").select("name", F.col("number").cast("long").alias("id"))
    entities = ranked(triples.select(F.explode(F.array("source", "target")).alias("name")))
    relations = ranked(triples.select(F.col("type").alias("name")))
    out = triples.join(entities.select(F.col("name").alias("source"), F.col("id").alias("h")), "source").join(entities.select(F.col("name").alias("target"), F.col("id").alias("t")), "target")
    return entities, relations, out.join(relations.select(F.col("name").alias("type"), F.col("id").alias("r")), "type").select("h", "r", "t")


def translation_scores(triples: DataFrame, entities: DataFrame, relations: DataFrame, projection: list[list[float]] | None = None) -> DataFrame:
    """triples (source, type, target) with score = |hM + r - t|, the smaller the likelier.

    entities: (entity, vector); relations: (type, vector). M is the projection, rows by the head's numbers, the unit matrix if
    it isn't given; it has as many numbers as a vector squared and goes into the expression."""
    head = F.col("hv")
    if projection is not None:
        columns = [F.array(*[F.lit(float(row[j])) for row in projection]) for j in range(len(projection[0]))]
        head = F.array(*[dot(head, c) for c in columns])
    joined = triples.join(entities.select(F.col("entity").alias("source"), F.col("vector").alias("hv")), "source").join(entities.select(F.col("entity").alias("target"), F.col("vector").alias("tv")), "target").join(relations.select("type", F.col("vector").alias("rv")), "type")
    moved = F.zip_with(head, F.col("rv"), lambda x, y: x + y)
    return joined.select(*triples.columns, F.round(l2(moved, F.col("tv")), 9).alias("score"))


def trained(triples: DataFrame, dim: int = 128, margin: float = 1.0, rate: float = 1e-3, batch: int = 128, epochs: int = 50, seed: int = 42, parts: bool = False) -> DataFrame:
    """(entity, vector): margin-ranking training with corrupted heads or tails, in shuffled batches by Adam; relations too with parts,
    as (kind, name, vector) of kinds entity and relation.

    Training is sequential by nature and runs in one task, whose memory holds the graph's triples: graphs of concepts are small
    by contract. Seeds and the order of names and triples are fixed, so the same graph gives the same vectors."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*part["source"], *part["target"]})
        kinds = sorted(set(part["type"]))
        at, kind = {n: i for i, n in enumerate(names)}, {n: i for i, n in enumerate(kinds)}
        h, t, r = part["source"].map(at).to_numpy(), part["target"].map(at).to_numpy(), part["type"].map(kind).to_numpy()
        order = np.lexsort((r, t, h))
        h, t, r = h[order], t[order], r[order]
        rng = np.random.default_rng(seed)
        bound = lambda n: np.sqrt(6.0 / (n + dim))
        weights = np.concatenate([rng.uniform(-bound(n), bound(n), (n, dim)) for n in (len(names), len(kinds))])
        first, second, steps = np.zeros_like(weights), np.zeros_like(weights), 0
        for _ in range(epochs):
            shuffled = rng.permutation(len(h))
            for start in range(0, len(h), batch):
                own = shuffled[start : start + batch]
                a, b, q = h[own], t[own], r[own] + len(names)
                head, other = rng.random(len(own)) < 0.5, rng.integers(0, len(names), len(own))
                na, nb = np.where(head, other, a), np.where(head, b, other)
                good, bad = weights[a] + weights[q] - weights[b], weights[na] + weights[q] - weights[nb]
                near, far = (np.sqrt((x**2).sum(1, keepdims=True) + 1e-12) for x in (good, bad))
                on = (margin + near - far > 0) / len(own)
                g, n = on * good / near, on * bad / far
                gradient = np.zeros_like(weights)
                for target, step in ((a, g), (b, -g), (na, -n), (nb, n), (q, g - n)):
                    np.add.at(gradient, target, step)
                steps += 1
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient**2
                weights -= rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        return pd.DataFrame({"kind": ["entity"] * len(names) + ["relation"] * len(kinds), "name": names + kinds, "vector": [x.tolist() for x in weights]})

    made = triples.select("source", "target", "type").groupBy().applyInPandas(fit, "kind string, name string, vector array<double>")
    return made if parts else made.where("kind = 'entity'").select(F.col("name").alias("entity"), "vector")


def entity_table(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity ids by seq of the nodes, relation ids of all edges, triples h, r, t of the edges with both ends): ids from 0 on."""
    entities = numbered(nodes.withColumn("__all", F.lit(0)), "__all", "seq").select("id", F.col("number").alias("e"))
    relations = numbered(edges.select("type").distinct().withColumn("__all", F.lit(0)), "__all", "type").select("type", F.col("number").alias("r"))
    both = edges.join(entities.select(F.col("id").alias("source"), F.col("e").alias("h")), "source").join(entities.select(F.col("id").alias("target"), F.col("e").alias("t")), "target")
    return entities, relations, both.join(relations, "type").select("h", "r", "t")


def nearest_l2(vectors: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """(source, target, distance, rank) of the nearest entities, itself included."""
    found = exact(vectors.select(F.col("entity").alias("doc_id"), "vector"), sources.select(F.col("entity").alias("qid"), "vector"), k, metric="l2")
    return found.select(F.col("qid").alias("source"), F.col("doc_id").alias("target"), F.col("score").alias("distance"), "rank")


def nearest_cosine(vectors: DataFrame, sources: DataFrame, lang: str, k: int = 5) -> DataFrame:
    """(source, target, similarity, rank) among entities whose id begins with the language."""
    there = vectors.where(F.col("entity").startswith(f"{lang}_")).select(F.col("entity").alias("doc_id"), "vector")
    found = exact(there, sources.select(F.col("entity").alias("qid"), "vector"), k, metric="cosine")
    return found.select(F.col("qid").alias("source"), F.col("doc_id").alias("target"), F.col("score").alias("similarity"), "rank")


def seed_distance(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """Mean distance of the seed pairs (entity1, entity2) that have vectors."""
    a = vectors.select(F.col("entity").alias("entity1"), F.col("vector").alias("v1"))
    b = vectors.select(F.col("entity").alias("entity2"), F.col("vector").alias("v2"))
    return seeds.join(a, "entity1").join(b, "entity2").agg(F.count("*").alias("pairs"), F.round(F.avg(l2(F.col("v1"), F.col("v2"))), 6).alias("mean_distance"))

