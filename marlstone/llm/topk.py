"""Exact top-k by inner product: norm-bucketed retrieval of a stated query set, in blocks.

Vectors are grouped by their length in buckets of a constant ratio, and buckets are cut into blocks of bounded size. First
each query meets one block of the longest bucket; its k-th best score there is a floor that its result can't fall below. A
bucket whose greatest length times the query's is less than the floor is out for that query, with all its blocks. For the
rest a block of queries meets a block of candidates in one task, where candidates go from the longest to the shortest in
runs. For each run and query the score to beat gives a local cosine threshold, the score over both lengths. Above 1, the run
is out for that query (length pruning). If it is high, the coordinates that weigh most in the run are multiplied first and
the rest is bounded by the tails' lengths (coordinate pruning). What is left is verified by whole products.

Components are whole numbers. Where a block's products could pass 2**53, which float64 doesn't hold exactly, its products are
those of Python's integers; a score beyond a long is the nearest long.

Nulls: vectors that are null or have null or non-finite components take no part, neither do rows with a null id. Empty
vectors score 0. A query meets vectors of its own dimension only. Rows that repeat an id are all candidates, except for a
query of that id; each repeated query row is answered once. Ties go to the smaller id, also at the last rank. Long vectors
are multiplied whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import common

SCALE = 64
K = 20
EVERY = 20  # ids that it divides are queries
BLOCK = 4096
RUN = 1024
#: Ratio of lengths within a bucket.
RATIO = 1.25
#: Local cosine threshold from which coordinates are pruned before whole products.
HIGH = 0.6
HEAD = 24  # coordinates multiplied first


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array of whole numbers, dim, bucket by length) of the valid rows."""
    v = F.col(vector_col)
    valid = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = vectors.where(valid).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    bucket = F.when(squares > 0, F.floor(F.log(squares) / (2 * math.log(RATIO)))).otherwise(-1).cast("int")
    return rows.select("id", "v", F.size("v").alias("dim"), bucket.alias("bucket"))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products, exact: of integers where float64 isn't, as float64 or integers within a long."""
    if float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 2**53:
        return queries @ vectors.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(vectors).T, -(2**63), 2**63 - 1)


def best_of_integers(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best() where products pass 2**53: all of them as integers, no bounds from floats."""
    at, of, score = [], [], []
    for i in range(len(queries)):
        each = products(queries[i : i + 1], vectors)[0]
        order = sorted((-int(each[j]), int(names[j]), j) for j in range(len(names)) if names[j] != ids[i])[:k]
        at += [i] * len(order)
        of += [j for *_, j in order]
        score += [-s for s, *_ in order]
    return np.array(at, np.int64), np.array(of, np.int64), np.array(score, np.int64)


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best products with the vectors, without its own id; floors: scores below which nothing is wanted."""
    if len(vectors) and len(queries) and float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] >= 2**53:
        return best_of_integers(queries, ids, vectors, names, k)
    lengths, q_lengths = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    order = np.lexsort((names, -lengths))
    vectors, names, lengths = vectors[order], names[order], lengths[order]
    n = len(queries)
    floors = np.full(n, -np.inf) if floors is None else floors
    top = np.full((n, k), -np.inf)
    rows = np.full((n, k), -1)
    for a in range(0, len(vectors), RUN):
        run, run_names, run_lengths = vectors[a : a + RUN], names[a : a + RUN], lengths[a : a + RUN]
        floor = np.maximum(top[:, -1], floors)  # a score to beat, or to tie with a smaller id
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isneginf(floor), -np.inf, np.where(q_lengths * run_lengths[0] > 0, floor / (q_lengths * run_lengths[0]), np.where(floor > 0, np.inf, -np.inf)))
        alive = np.flatnonzero(local <= 1 + 1e-9)
        for own in (alive[local[alive] >= HIGH], alive[local[alive] < HIGH]):
            if not len(own):
                continue
            some = queries[own]
            if local[own[0]] >= HIGH and run.shape[1] > 2 * HEAD:
                weight = np.argsort(-np.abs(some).sum(0) * np.abs(run).sum(0), kind="stable")
                head, tail = weight[:HEAD], weight[HEAD:]
                bound = some[:, head] @ run[:, head].T + np.linalg.norm(some[:, tail], axis=1)[:, None] * np.linalg.norm(run[:, tail], axis=1)[None, :]
                able = np.flatnonzero((bound >= floor[own][:, None] - 1e-6).any(0))
            else:
                able = np.arange(len(run))
            if not len(able):
                continue
            scores = products(some, run[able])
            scores[(run_names[able][None, :] == ids[own][:, None]) | (scores < floors[own][:, None])] = -np.inf
            # the run's k best by (score, smaller id), merged with those held
            both = np.concatenate([top[own], scores], axis=1)
            where = np.concatenate([rows[own], np.broadcast_to(able + a, scores.shape)], axis=1)
            cut = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
            near = np.nonzero((both >= cut[:, None]) & ~np.isneginf(both))
            keep = where[near] >= 0
            r, w, s = near[0][keep], where[near][keep], both[near][keep]
            sort = np.lexsort((names[w], -s, r))
            r, w, s = r[sort], w[sort], s[sort]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            fit = place < k
            fit &= ~np.isneginf(s)
            top[own], rows[own] = -np.inf, -1
            top[own[r[fit]], place[fit]] = s[fit]
            rows[own[r[fit]], place[fit]] = w[fit]
    held = np.nonzero(rows >= 0)
    return held[0], order[rows[held]], top[held].astype(np.int64)


def dense(part: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    part = part.combine_chunks()
    flat = part.column("v").combine_chunks()
    flat = flat.values if isinstance(flat, pa.ListArray) else flat.chunk(0).values
    return part.column("id").to_numpy(), flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def met(queries: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: k best of each query (id, v, floor, q, b, d, i) within each block (b, d, i) of the others that it is sent to."""

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            dim = key[2].as_py()
            (ids, q), (names, v) = dense(left, dim), dense(right, dim)
            at, of, score = best(q, ids, v, names, k, left.column("floor").to_numpy())
            made = ids[at], names[of], score
        else:
            made = (np.empty(0, np.int64),) * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, made))))

    # columns of their own: both sides come from one table, and Spark takes columns of the same origin for one
    queries, others = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (queries, others))
    return queries.groupBy("q", "b", "d", "i").cogroup(others.groupBy("q", "b", "d", "i")).applyInArrow(meet, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores."""
    rows = scaled(vectors, id_col, vector_col)
    # a row for each bucket and dimension, which lengths bound: how many rows and queries it has
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    counts = rows.groupBy("bucket", "dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % EVERY == 0).alias("q"), F.sqrt(F.max(square)).alias("most")).orderBy("dim", F.desc("bucket")).collect()
    if not counts:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
    asked: dict[int, int] = {}
    longest: dict[int, int] = {}  # of each dimension the longest bucket that can fill a result, if there is one
    for r in counts:
        asked[r.dim] = asked.get(r.dim, 0) + r.q
        if r.n > k:
            longest.setdefault(r.dim, r.bucket)
    buckets = F.array(*[F.struct(F.lit(r.bucket).alias("b"), F.lit(r.dim).alias("d"), F.lit(-(-r.n // BLOCK)).alias("n"), F.lit(r.most).alias("most")) for r in counts])
    looked_up = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    n_query_blocks = looked_up({d: max(1, -(-q // BLOCK)) for d, q in asked.items()}, F.col("dim"))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    own = F.element_at(F.filter(buckets, lambda c: (c["b"] == F.col("bucket")) & (c["d"] == F.col("dim"))), 1)
    dealt = rows.withColumn("i", (spread % own["n"]).cast("int"))
    others = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), n_query_blocks - 1))).select("id", "v", F.col("q").cast("long").alias("q"), F.col("bucket").alias("b"), F.col("dim").alias("d"), "i")
    queries = rows.where(F.col("id") % EVERY == 0).dropDuplicates(["id", "v"]).withColumn("q", (spread % n_query_blocks).cast("long"))
    if longest:
        start = F.col("b") == looked_up(longest, F.col("d"))
        first = queries.where(F.col("dim").isin(list(longest))).select("id", "v", F.lit(float("-inf")).alias("floor"), "q", looked_up(longest, F.col("dim")).alias("b"), F.col("dim").alias("d"), F.lit(0).alias("i"))
        scores = met(first, others.where(start & (F.col("i") == 0)), k)
        floors = scores.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "floor")
        queries = queries.join(common.checkpointed(floors), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    else:
        queries = queries.withColumn("floor", F.lit(float("-inf")))
    able = F.filter(buckets, lambda c: (c["d"] == F.col("dim")) & (F.col("floor") <= c["most"] * F.sqrt(square) * (1 + 1e-9) + 1e-6))
    sent = queries.select("id", "v", "floor", "q", F.explode(able).alias("c")).select("id", "v", "floor", "q", "c.b", "c.d", F.explode(F.sequence(F.lit(0), F.col("c.n").cast("int") - 1)).alias("i"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met(sent, others, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """The same in DuckDB SQL, by all products."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
    """
