"""Building the knowledge graph from entities, relations and alignments, and its statistics.

Nodes: id, name, lang, type, seq. Edges: source, target, type, weight, seq. seq is the order of insertion, on which "first
wins" rules depend; a DataFrame has no order of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from marlstone.functions.lineage import kept
from marlstone.operators import connect


#: Names of difficulties, the easiest first; fixed values.
LEVELS = ("beginner", "intermediate", "advanced")


def mentions_of(batches: DataFrame) -> DataFrame:
    """Mentions (name, lang, type, source_doc, seq) of entity batches (doc_id, lang, entities, seq): one for each element of the
    array, in its order; the name is the element's `entity`, or its `text` where that is null or missing."""
    has = {f.name for f in batches.schema["entities"].dataType.elementType.fields}
    name = F.coalesce(*[F.col(f"e.{c}") for c in ("entity", "text") if c in has])
    kind = F.col("e.type") if "type" in has else F.lit(None).cast("string")
    each = batches.select("doc_id", "lang", "seq", F.posexplode("entities").alias("at", "e"))
    return each.select(name.alias("name"), F.coalesce("lang", F.lit("unknown")).alias("lang"), kind.alias("type"), F.col("doc_id").cast("string").alias("source_doc"), F.struct("seq", "at").alias("seq"))


def nodes(mentions: DataFrame) -> DataFrame:
    """Nodes of mentions (name, lang, type, source_doc, seq): the first of each lower-case name and language; ids number each type across languages."""
    named = mentions.where(F.coalesce(F.trim("name"), F.lit("")) != "").withColumn("type", F.coalesce("type", F.lit("CONCEPT")))
    first = named.groupBy(F.lower(F.concat_ws("_", "name", "lang")).alias("k")).agg(F.min(F.struct("seq", "name", "lang", "type", "source_doc")).alias("m")).select("m.*")
    return numbered(first, "type", "seq").select(F.format_string("%s_%s_%06d", "lang", "type", "number").alias("id"), "name", "lang", "type", "source_doc", "seq")


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with a number from 0 on within their group, by order; a group's rows are numbered in ranges, so no task holds a group.

    The rows are kept sorted in ranges of (group, order); a range's rows of a group are numbered by themselves and moved on by
    what the ranges before it have, a table of a row for each range and group."""
    dealt = kept(rows.repartitionByRange(group, order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), before.alias("__before"))
    local = F.row_number().over(W.partitionBy(group, "__range").orderBy(order)) - 1
    placed = dealt.withColumn("__local", local).join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__of")))
    return placed.withColumn("number", F.col("__local") + F.col("__before")).drop("__range", "__local", "__group", "__of", "__before")


def ids_by_name(node_table: DataFrame) -> DataFrame:
    """(name, id): the first node of each lower-case name in any language."""
    return node_table.groupBy(F.lower("name").alias("name")).agg(F.min_by("id", "seq").alias("id"))


def edges(relations: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges of relations (head, tail, type) between known names; a multigraph."""
    ids = ids_by_name(node_table)
    named = relations.where((F.coalesce("head", F.lit("")) != "") & (F.coalesce("tail", F.lit("")) != ""))
    named = named.select(F.lower("head").alias("h"), F.lower("tail").alias("t"), F.coalesce("type", F.lit("RELATED_TO")).alias("type"))
    out = named.join(ids.select(F.col("name").alias("h"), F.col("id").alias("source")), "h").join(ids.select(F.col("name").alias("t"), F.col("id").alias("target")), "t")
    return out.select("source", "target", "type")


def alignment_edges(pairs: DataFrame, node_table: DataFrame) -> DataFrame:
    """ALIGNED_WITH edges of pairs (entity1, entity2)."""
    made = edges(pairs.select(F.col("entity1").alias("head"), F.col("entity2").alias("tail"), F.lit("ALIGNED_WITH").alias("type")), node_table)
    return made.withColumn("bidirectional", F.lit(True))


def upsert(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key by seq; of rows with the same seq the one whose other columns are the greatest, in their order."""
    rest = [c for c in rows.columns if c not in key]
    order = ["seq", *(c for c in rest if c != "seq" and not isinstance(rows.schema[c].dataType, MapType))]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*key, "m.*")


def upsert_edges(rows: DataFrame, node_table: DataFrame, key: tuple[str, ...] = ("source", "target", "type")) -> DataFrame:
    """The last row of each edge both of whose ends are nodes; others are left out."""
    known = node_table.select("id").distinct()
    for end in ("source", "target"):
        rows = rows.join(known.select(F.col("id").alias(end)), end, "left_semi")
    return upsert(rows, list(key))


def imported(node_rows: DataFrame, edge_rows: DataFrame, held: tuple[DataFrame, DataFrame] | None = None, clear: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables after an import: rows that are there and new ones, the last of each id or edge, edges with both ends.

    held: the tables before, whose rows come first; with clear they are dropped. seq has to grow from one import to the next."""
    if held is not None and not clear:
        node_rows, edge_rows = held[0].unionByName(node_rows, allowMissingColumns=True), held[1].unionByName(edge_rows, allowMissingColumns=True)
    nodes_ = upsert(node_rows, ["id"])
    return nodes_, upsert_edges(edge_rows, nodes_)


def repeated_ids(rows: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Keys that stand in several rows, with their number: an empty result says that the key is unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def adjacency_sample(node_table: DataFrame, edge_table: DataFrame, k: int = 5) -> DataFrame:
    """(name, type, target): the first k edges by seq with the names of their ends, as a report shows them."""
    few = edge_table.orderBy("seq", "source", "target", "type").limit(k)
    names = node_table.select("id", "name")
    return few.join(names.select(F.col("id").alias("source"), "name"), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target").select("name", "type", F.col("target_name").alias("target"))


def basic_stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(kind, name, n): totals, nodes by language and by type, edges by type, by grouping sets."""
    n = node_table.groupingSets([[F.col("lang")], [F.col("type")], []], "lang", "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    n = n.select(F.when(F.col("g") == 1, "node_lang").when(F.col("g") == 2, "node_type").otherwise("nodes").alias("kind"), F.coalesce("lang", "type", F.lit("all")).alias("name"), "n")
    e = edge_table.groupingSets([[F.col("type")], []], "type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return n.unionByName(e.select(F.when(F.col("g") == 0, "edge_type").otherwise("edges").alias("kind"), F.coalesce("type", F.lit("all")).alias("name"), "n"))


def degrees(edge_table: DataFrame) -> DataFrame:
    """(id, n_in, n_out) of all ends, also dangling ones; one shuffle over both ends."""
    ends = edge_table.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def degree_stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Averages over nodes with a degree above 0 on that side, maxima, isolated nodes."""
    d = degrees(edge_table)
    alone = node_table.join(d, "id", "left_anti").agg(F.count("*").alias("isolated"))
    stats = d.agg(
        F.round(F.avg(F.when(F.col("n_in") > 0, F.col("n_in"))), 6).alias("avg_in"), F.max("n_in").alias("max_in"),
        F.round(F.avg(F.when(F.col("n_out") > 0, F.col("n_out"))), 6).alias("avg_out"), F.max("n_out").alias("max_out"),
    )
    return stats.join(alone)  # one row each


def top_nodes(node_table: DataFrame, edge_table: DataFrame, k: int = 10) -> DataFrame:
    """The k ends of most edges; dangling ones take places but aren't shown."""
    best = degrees(edge_table).withColumn("degree", F.col("n_in") + F.col("n_out")).orderBy(F.desc("degree"), "id").limit(k)
    return best.join(node_table.select("id", "name", "lang", "type"), "id")


def node_numbers(node_table: DataFrame) -> DataFrame:
    """(id, seq, number): nodes by their least seq, ties by id, numbered from 0 on; rows of one id are one node."""
    first = node_table.where("id IS NOT NULL").groupBy("id").agg(F.min("seq").alias("seq")).withColumn("__order", F.struct("seq", "id")).withColumn("__all", F.lit(0))
    return kept(numbered(first, "__all", "__order").select("id", "seq", F.col("number").cast("long").alias("number")))


def _labelled(numbers: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, label): the seq of each node's root (number, root), of the node itself where it has none."""
    placed = numbers.join(roots, "number", "left").select("id", F.coalesce("root", "number").alias("root"))
    return placed.join(numbers.select(F.col("number").alias("root"), F.col("seq").alias("label")), "root").select("id", "label")


def components(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(label, size) by greedy reachability: nodes in order take what they reach along edges and isn't taken yet."""
    numbers = node_numbers(node_table)
    roots = connect.reaching(numbers, connect.links_of(numbers, edge_table)).withColumnRenamed("label", "root")
    return _labelled(numbers, roots).groupBy("label").agg(F.count("*").alias("size"))


def weak_components(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(label, size) without regard to direction."""
    numbers = node_numbers(node_table)
    return _labelled(numbers, connect.weak(connect.links_of(numbers, edge_table))).groupBy("label").agg(F.count("*").alias("size"))


def strong_labels(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(id, label): the least seq of the nodes that a node reaches and that reach it, itself included."""
    numbers = node_numbers(node_table)
    placed = numbers.join(connect.strong(connect.links_of(numbers, edge_table)), "number", "left").select("id", "number", F.coalesce("root", "number").alias("root"))
    least = placed.groupBy("root").agg(F.min("number").alias("least")).join(numbers.select(F.col("number").alias("least"), F.col("seq").alias("label")), "least")
    return placed.join(least.select("root", "label"), "root").select("id", "label")


def strong_components(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(label, size) of strong components, single nodes included."""
    return strong_labels(node_table, edge_table).groupBy("label").agg(F.count("*").alias("size"))


def alignment_stats(node_table: DataFrame, edge_table: DataFrame, kind: str = "ALIGNED_WITH") -> DataFrame:
    """(kind, name, value): alignment edges, pairs of languages, aligned nodes and coverage, also by language."""
    aligned = edge_table.where(F.col("type") == kind).select("source", "target")
    lang = node_table.select("id", "lang")
    pairs = aligned.join(lang.select(F.col("id").alias("source"), F.col("lang").alias("l1")), "source").join(lang.select(F.col("id").alias("target"), F.col("lang").alias("l2")), "target")
    pairs = pairs.groupBy(F.array_join(F.array_sort(F.array("l1", "l2")), "-").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("pair").alias("kind"), "name", "value")
    ends = aligned.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    total = aligned.agg(F.count("*").cast("double").alias("value")).select(F.lit("edges").alias("kind"), F.lit("all").alias("name"), "value")
    n_ends = ends.agg(F.count("*").cast("double").alias("value")).select(F.lit("aligned_nodes").alias("kind"), F.lit("all").alias("name"), "value")
    flagged = node_table.join(ends.withColumn("hit", F.lit(1)), "id", "left")
    by_lang = flagged.groupBy("lang").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("value")).select(F.lit("coverage").alias("kind"), F.col("lang").alias("name"), "value")
    overall = flagged.agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)), 6).alias("value")).select(F.lit("coverage").alias("kind"), F.lit("all").alias("name"), "value")
    return total.unionByName(pairs).unionByName(n_ends).unionByName(by_lang).unionByName(overall)


def ontology_violations(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(rule, source, target): alignments within a language, prerequisite edges on a cycle, and, where nodes have a difficulty,
    prerequisite edges from a harder to an easier concept (difficulty as a number, or one of LEVELS)."""
    lang = node_table.select("id", "lang")
    same = edge_table.where("type = 'ALIGNED_WITH'").join(lang.select(F.col("id").alias("source"), F.col("lang").alias("l1")), "source").join(lang.select(F.col("id").alias("target"), F.col("lang").alias("l2")), "target")
    same = same.where("l1 = l2").select(F.lit("aligned_within_language").alias("rule"), "source", "target")
    needs = edge_table.where("type = 'PREREQUISITE'").select("source", "target").distinct()
    cyclic = on_cycles(needs).select(F.lit("prerequisite_cycle").alias("rule"), "source", "target")
    found = same.unionByName(cyclic)
    if "difficulty" in node_table.columns:
        grade = F.coalesce(*[F.when(F.lower("difficulty") == name, float(i)) for i, name in enumerate(LEVELS)], F.expr("try_cast(difficulty AS double)"))
        graded = node_table.select("id", grade.alias("grade")).where("grade IS NOT NULL")
        both = needs.join(graded.select(F.col("id").alias("source"), F.col("grade").alias("g1")), "source").join(graded.select(F.col("id").alias("target"), F.col("grade").alias("g2")), "target")
        found = found.unionByName(both.where("g1 > g2").select(F.lit("prerequisite_harder").alias("rule"), "source", "target"))
    return found


def on_cycles(links: DataFrame) -> DataFrame:
    """The links (source, target) that lie on a cycle, however long: those within a strong component, and links of a node to itself."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).withColumn("seq", F.lit(0))
    numbers = node_numbers(ends)
    named = kept(connect.links_of(numbers, links.distinct()))
    roots = connect.strong(named)
    both = named.join(roots.select(F.col("number").alias("a"), F.col("root").alias("r1")), "a", "left").join(roots.select(F.col("number").alias("b"), F.col("root").alias("r2")), "b", "left")
    return both.where(F.coalesce("r1", "a") == F.coalesce("r2", "b")).select("source", "target")
