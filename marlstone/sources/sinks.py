"""Writing runs, graphs, metrics and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def run(df: DataFrame, path: str, kind: str = "jsonl", name: str = "FUSION") -> None:
    """A run as JSON lines or TREC text; an unknown kind is an error."""
    if kind == "jsonl":
        json_lines(df.withColumn("run_name", F.lit(name)), path)
    elif kind == "trec":
        qid = F.coalesce(F.col("qid").cast("string"), F.lit("Q0"))
        line = F.format_string("%s Q0 %s %d %.6f %s", qid, F.col("doc_id").cast("string"), "rank", "score", F.lit(name))
        df.sortWithinPartitions("qid", "rank").select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind: {kind}")


def index(df: DataFrame, path: str, by: str | None = None, fresh: bool = False) -> None:
    """An index table (vectors, postings, cells): appended, or written anew; `by` names its partition column."""
    out = df.write.mode("overwrite" if fresh else "append")
    (out.partitionBy(by) if by else out).parquet(path)


def index_statistics(df: DataFrame) -> DataFrame:
    """Number of rows and names of the columns of an index table."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(",".join(df.columns)))


def metrics_json(metrics: DataFrame, path: str, name: str = "run") -> None:
    """One object of metric values; metrics: (metric, value)."""
    packed = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    packed.select(F.to_json(F.struct(F.lit(name).alias("run"), "metrics")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def table(rows: DataFrame, kind: str = "markdown", places: int = 4, bold: bool = True) -> str:
    """A small result as a Markdown or LaTeX table; the largest number of each column is bold."""
    names, data = rows.columns, [list(r) for r in rows.orderBy(rows.columns[0]).collect()]
    best = [max((r[i] for r in data if isinstance(r[i], float)), default=None) for i in range(len(names))]
    strong = (lambda x: f"\\textbf{{{x}}}") if kind == "latex" else (lambda x: f"**{x}**")

    def cell(value, top) -> str:
        if value is None:
            return "-"
        shown = f"{value:.{places}f}" if isinstance(value, float) else str(value)
        return strong(shown) if bold and isinstance(value, float) and value == top else shown

    body = [[cell(v, best[i]) for i, v in enumerate(r)] for r in data]
    if kind == "latex":
        lines = [" & ".join(names) + r" \\ \hline", *(" & ".join(r) + r" \\" for r in body)]
        return "\\begin{tabular}{" + "l" * len(names) + "}\n" + "\n".join(lines) + "\n\\end{tabular}"
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *body])


def shown(results: DataFrame, k: int = 10) -> list[str]:
    """The first k results as lines with a snippet of 160 characters."""
    snippet = F.substring(F.translate(F.coalesce("content", F.lit("")), "\n\r", "  "), 1, 160)
    rows = results.orderBy("qid", "rank").limit(k).select("rank", "doc_id", "title", snippet.alias("s")).collect()
    return [f"{r['rank']}. {r['doc_id']} {r['title'] or ''} {r['s']}" for r in rows]


def json_report(rows: DataFrame, path: str) -> None:
    """A JSON object a line for each row of a report, such as those of learner.report(), in one file a task."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def ablation_summary(scores: DataFrame, weights: tuple[tuple[str, float, float, float], ...], path: str | None = None) -> str:
    """The ablation as a Markdown table: a row for each run with its weights, "-" for one of zero, the best metrics bold; scores: run, ndcg, mrr, recall.

    With a path, the same rows also go there as one JSON object. There are as many rows as runs."""
    found = {r["run"]: r for r in scores.collect()}
    names = ("ndcg", "mrr", "recall")
    best = {n: max((r[n] for r in found.values()), default=None) for n in names}
    shown = lambda n, r: "-" if r is None else f"**{r[n]:.4f}**" if r[n] == best[n] else f"{r[n]:.4f}"
    lines = ["| " + " | ".join(("run", "dense", "sparse", "kg", *names)) + " |", "| " + " | ".join(["---"] * 7) + " |"]
    lines += ["| " + " | ".join([run, *(f"{w:g}" if w else "-" for w in given), *(shown(n, found.get(run)) for n in names)]) + " |" for run, *given in weights]
    if path:
        rows = scores.withColumn("all", F.struct("run", *names)).agg(F.array_sort(F.collect_list("all")).alias("results"))
        rows.select(F.to_json(F.struct("results")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return "\n".join(lines)


def graph_report(basic: DataFrame, degrees: DataFrame, alignment: DataFrame, components: DataFrame, top_nodes: DataFrame) -> str:
    """A graph's statistics as Markdown, from the tables of the graph operators: a row for each language, type and pair."""
    by: dict[str, list] = {}
    for r in [*basic.collect(), *alignment.collect()]:
        by.setdefault(r[0], []).append((r[1], r[2]))
    d = degrees.first()
    sizes = components.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).limit(20).collect()
    part = lambda title, rows: [f"## {title}", "", "| name | value |", "| --- | --- |", *(f"| {a} | {b:g} |" if isinstance(b, float) else f"| {a} | {b} |" for a, b in rows), ""]
    lines = ["# Graph", "", *part("Size", [(k, by[k][0][1]) for k in ("nodes", "edges") if k in by])]
    for title, kind in (("Nodes by language", "node_lang"), ("Nodes by type", "node_type"), ("Edges by type", "edge_type"), ("Alignments by languages", "pair"), ("Alignment coverage", "coverage")):
        lines += part(title, sorted(by.get(kind, []), key=str))
    lines += part("Degrees", [(n, d[n]) for n in ("avg_in", "max_in", "avg_out", "max_out", "isolated")])
    lines += part("Components by size", [(f"{r['size']} nodes", r["n"]) for r in sizes])
    lines += part("Nodes of most edges", [(r["name"], r["degree"]) for r in top_nodes.orderBy(F.desc("degree"), "id").collect()])
    return "\n".join(lines)


def model(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Embeddings as two Parquet tables, entities (entity, vector) and relations (type, vector)."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
