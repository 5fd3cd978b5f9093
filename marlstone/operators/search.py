"""Search from end to end: linking, the three sources, fusion; baselines and their evaluation."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import top
from marlstone.functions.lineage import kept
from marlstone.operators import dense, expand, fusion, linking, metrics, sparse

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def link_queries(queries: DataFrame, nodes: DataFrame, entities: DataFrame | None = None, threshold: float = linking.FUZZY) -> DataFrame:
    """(qid, mention, id, confidence): the nodes of each query (qid, query, lang).

    Its mentions are those of entities (qid, mention, type), if a recogniser made them, else the whole query as a concept. A
    null language, or 'auto', is no filter; blank queries have no mention."""
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    lang = F.col("lang") if "lang" in queries.columns else F.lit(None).cast("string")
    if entities is None:
        mentions = asked.select("qid", F.col("query").alias("mention"), lang.alias("lang"), F.lit("CONCEPT").alias("type"))
    else:
        mentions = entities.join(asked.select("qid", lang.alias("lang")), "qid").select("qid", "mention", "lang", "type")
    found = linking.link(mentions.select("mention", "lang", "type").distinct(), nodes, threshold, keep=("lang", "type"))
    same = (F.col("a.mention") == F.col("b.mention")) & F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.type").eqNullSafe(F.col("b.type"))
    return mentions.alias("a").join(found.alias("b"), same).select("a.qid", "a.mention", "b.id", "b.confidence")


def graph_run(queries: DataFrame, docs: DataFrame, graph: Graph, hops: int = 2, k: int = 50, entities: DataFrame | None = None, threshold: float = linking.FUZZY) -> DataFrame:
    """(qid, doc_id, score, rank): documents by their concepts' best paths from the nodes that the query is linked to."""
    linked = link_queries(queries, graph.nodes, entities, threshold).select(F.col("qid").alias("seed"), "id").distinct()
    paths = expand.scored_paths(expand.edge_paths(expand.hops(linked, graph.edges, hops)))
    return expand.document_run(expand.node_scores(paths), docs, k)


def sparse_run(queries: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """BM25 in which a query with a language other than 'auto' finds documents of that language only."""
    if "lang" not in queries.columns:
        return sparse.bm25(docs, queries, k)
    free = F.coalesce("lang", F.lit("auto")) == "auto"
    scored = sparse.bm25(docs, queries, scores_only=True).join(queries.select("qid", F.when(~free, F.col("lang")).alias("__lang")), "qid")
    fit = scored.join(docs.select("doc_id", F.col("lang").alias("__of")), "doc_id").where(F.col("__lang").isNull() | (F.col("__lang") == F.col("__of")))
    return top(fit.select("qid", "doc_id", "score"), ["qid"], [F.desc("score"), F.col("doc_id")], k)


def runs(queries: DataFrame, docs: DataFrame, graph: Graph | None = None, k: int = 50, vectors: tuple[DataFrame, DataFrame] | None = None, threshold: float = linking.FUZZY) -> dict[str, DataFrame]:
    """The runs of the three sources by name; without a graph there are two. vectors: documents' and queries', else hashed ones."""
    asked = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    held, of_queries = vectors or (dense.hashed(docs, "doc_id", "content"), dense.hashed(asked, "qid", "query"))
    out = {"dense": dense.exact(held, of_queries, k), "sparse": sparse_run(asked, docs, k)}
    return out | ({} if graph is None else {"kg": graph_run(asked, docs, graph, k=k, threshold=threshold)})


def search(queries: DataFrame, docs: DataFrame, graph: Graph | None = None, use_kg: bool = True, k: int = config.TOP_K, explain: bool = False, by: tuple[float, float, float] = config.FUSION_WEIGHTS, per_source: int = 50, vectors: tuple[DataFrame, DataFrame] | None = None, threshold: float = linking.FUZZY) -> DataFrame:
    """(qid, doc_id, rank, fused_score, title, lang) of the k best documents of each query; blank queries have none.

    Without a graph, or with use_kg off, the graph's weight is 0 and the others are scaled. explain adds the components, the
    weights and the query."""
    use_kg = use_kg and graph is not None
    weights = by if use_kg else (by[0], by[1], 0.0)
    found = runs(queries, docs, graph if use_kg else None, per_source, vectors, threshold)
    none = found["sparse"].limit(0)
    fused = fusion.fuse(fusion.components(found["dense"], found["sparse"], found.get("kg", none)), by=weights, k=k)
    out = fusion.enriched(fused, docs)
    if not explain:
        return out.select("qid", "doc_id", "rank", "fused_score", "title", "lang")
    a, b, c = fusion.weights(*weights)
    asked = queries.select("qid", "query", *([F.col("lang").alias("query_lang")] if "lang" in queries.columns else []))
    return out.withColumns({"alpha": F.lit(a), "beta": F.lit(b), "gamma": F.lit(c)}).join(asked, "qid")


def baselines(found: dict[str, DataFrame | None], k: int = 100) -> dict[str, DataFrame]:
    """Runs (qid, doc_id, score, rank) by baseline: dense_only, sparse_only, and full of what there is.

    found: the sources' runs, None for one whose index is missing; its baseline is left out, and full goes without it."""
    there = {n: kept(run) for n, run in found.items() if run is not None}  # each is read twice, and is small
    for name in found.keys() - there.keys():
        log.warning("no index for %s, its baseline is left out", name)
    out = {f"{n}_only": run for n, run in there.items() if n != "kg"}
    if there:
        none = next(iter(there.values())).limit(0)
        weights = tuple(w if n in there else 0.0 for n, w in zip(fusion.SOURCES, config.FUSION_WEIGHTS))
        fused = fusion.fuse(fusion.components(*(there.get(n, none) for n in fusion.SOURCES)), by=weights, k=k)
        out["full"] = fused.select("qid", "doc_id", F.col("fused_score").alias("score"), "rank")
    return out


def evaluated(found: dict[str, DataFrame | None], qrels: DataFrame, k: int = 100) -> DataFrame:
    """A row of metrics for each baseline that there is."""
    return metrics.compare(baselines(found, k), qrels)
