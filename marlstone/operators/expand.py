"""Neighbourhoods, hops and paths in the knowledge graph, and scores from paths to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import top


def neighbours(edges: DataFrame, limit: int = 20, types: list[str] | None = None, by_weight: bool = False) -> DataFrame:
    """Each node's first `limit` out-edges: in their order and then of the given types, or by weight of these types."""
    order = [F.desc("weight"), F.col("target"), F.col("type")] if by_weight else [F.col("seq")]
    rows = edges.where(F.col("type").isin(types)) if types and by_weight else edges
    out = top(rows, ["source"], order, limit)
    return out.where(F.col("type").isin(types)) if types and not by_weight else out


def hops(seeds: DataFrame, edges: DataFrame, n: int = 2, fan_out: int = 20, types: list[str] | None = None) -> DataFrame:
    """(seed, hop, source, target, type, weight): at each hop all out-edges of the frontier; each node is expanded once per seed.

    seeds: (seed, id). The frontier drops what was visited by an anti join, so that cycles don't multiply rows."""
    out_edges = neighbours(edges, fan_out, types).select("source", "target", "type", "weight")
    frontier = seeds.select("seed", "id").distinct()
    visited, out = frontier, None
    for hop in range(1, n + 1):
        step = frontier.join(out_edges, frontier["id"] == out_edges["source"]).select("seed", F.lit(hop).alias("hop"), "source", "target", "type", "weight")
        out = step if out is None else out.unionByName(step)
        frontier = step.select("seed", F.col("target").alias("id")).distinct().join(visited, ["seed", "id"], "left_anti")
        visited = visited.unionByName(frontier)
    return out


def constrained(expanded: DataFrame, nodes: DataFrame, target_types: list[str] | None = None, min_weight: float = 0.0) -> DataFrame:
    kept = expanded.where(F.col("weight") >= min_weight)
    return kept if not target_types else kept.join(nodes.where(F.col("type").isin(target_types)).select(F.col("id").alias("target")), "target", "left_semi").select(expanded.columns)


def shortest(starts: DataFrame, ends: DataFrame, edges: DataFrame, max_length: int = 3) -> DataFrame:
    """(start, end, length, path): one shortest directed path for each pair, the least of equal ones.

    starts: (start), ends: (end). A node that is reached keeps only its least path, so a round has a row for each start and node."""
    links = edges.select("source", "target").distinct()
    front = starts.select("start").distinct().select("start", F.col("start").alias("at"), F.array("start").alias("path"))
    seen, out = front.select("start", "at"), None
    for length in range(1, max_length + 1):
        step = front.join(links, front["at"] == links["source"]).select("start", F.col("target").alias("at"), F.concat("path", F.array("target")).alias("path"))
        front = step.groupBy("start", "at").agg(F.min("path").alias("path")).join(seen, ["start", "at"], "left_anti")
        seen = seen.unionByName(front.select("start", "at"))
        hit = front.join(ends.select(F.col("end").alias("at")).distinct(), "at", "left_semi").select("start", F.col("at").alias("end"), F.lit(length).alias("length"), "path")
        out = hit if out is None else out.unionByName(hit)
    return out


def relation_weight(relation: Column, table: dict[str, float] | None = None) -> Column:
    out = F.lit(config.OTHER_RELATION_WEIGHT)
    for name, weight in (table or config.RELATION_WEIGHTS).items():
        out = F.when(relation == name, weight).otherwise(out)
    return out


def scored_paths(paths: DataFrame, method: str = "combined") -> DataFrame:
    """paths with depth, weight and relation scores and the combined one. Paths have length, relations and weights."""
    mean = lambda a, of: F.when(F.size(a) > 0, F.aggregate(F.transform(a, of), F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.5)
    out = paths.withColumns({
        "depth_score": F.exp(-0.5 * F.col("length")),
        "weight_score": mean(F.coalesce("weights", F.array().cast("array<double>")), lambda x: x.cast("double")),
        "relation_score": mean(F.coalesce("relations", F.array().cast("array<string>")), lambda x: relation_weight(x)),
    })
    combined = F.col("depth_score") * (0.8 * F.col("weight_score") + 0.2 * F.col("relation_score"))
    one = {"depth": F.col("depth_score"), "weight": F.col("weight_score"), "relation": F.col("relation_score")}
    return out.withColumn("score", F.round(one.get(method, combined), 9))


def explained_paths(paths: DataFrame) -> DataFrame:
    """Scored paths with their components as one column: score and what it is made of, with the relations' weights."""
    parts = F.struct("depth_score", "weight_score", "relation_score", F.transform("relations", lambda x: relation_weight(x)).alias("relation_weights"), F.col("score").alias("combined"))
    return scored_paths(paths).withColumn("explanation", parts)


def node_lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the given ids (id)."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def edge_paths(expanded: DataFrame) -> DataFrame:
    """The one-edge paths that expansion emits, stamped with their hop."""
    return expanded.select("seed", F.col("hop").alias("length"), F.array("type").alias("relations"), F.array(F.col("weight").cast("double")).alias("weights"), F.array("source", "target").alias("node_ids"))


def node_scores(paths: DataFrame, aggregation: str = "max") -> DataFrame:
    """(seed, id, score) from scored paths: both ends of a path get its score."""
    how = {"max": F.max, "avg": F.avg, "sum": F.sum}[aggregation]
    return paths.select("seed", F.explode("node_ids").alias("id"), "score").groupBy("seed", "id").agg(F.round(how("score"), 9).alias("score"))


def document_scores(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, score): the best concept of each document (doc_id, concepts) for each query (seed of scores), above 0."""
    concepts = docs.select("doc_id", F.explode("concepts").alias("id"))
    hit = concepts.join(scores.where("score > 0"), "id")
    return hit.groupBy(F.col("seed").alias("qid"), "doc_id").agg(F.max("score").alias("score"))


def document_run(scores: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank): the k best of document_scores() for each query.

    Documents of a concept have its score at least, so that one that k others of the concept precede by id is in no run through it."""
    scores = scores.where("score > 0")
    concepts = docs.select("doc_id", F.explode("concepts").alias("id")).join(scores.select("id").distinct(), "id", "left_semi").distinct()
    some = top(concepts, ["id"], [F.col("doc_id")], k).select("id", "doc_id")
    found = some.join(scores, "id").groupBy(F.col("seed").alias("qid"), "doc_id").agg(F.max("score").alias("score"))
    return top(found, ["qid"], [F.desc("score"), F.col("doc_id")], k)


def reranked(run: DataFrame, kg: DataFrame, alpha: float = 0.5) -> DataFrame:
    """run with alpha * graph score + (1 - alpha) * its own; documents without a graph score have 0."""
    joined = run.join(kg.select("qid", "doc_id", F.col("score").alias("kg_score")), ["qid", "doc_id"], "left")
    scored = joined.select("qid", "doc_id", F.round(alpha * F.coalesce("kg_score", F.lit(0.0)) + (1 - alpha) * F.col("score"), 9).alias("score"))
    return top(scored, ["qid"], [F.desc("score"), F.col("doc_id")], 2**31 - 1)
