"""Components of large graphs: weak ones, strong ones, and what reaches a node, in few rounds however long the paths are.

Nodes are numbered first, so that labels are numbers; links are (a, b) of such numbers. A round is one join and one aggregation
whose rows are links and nodes; nothing holds pairs of nodes that aren't links, or a node's links in one row. Keys that very many
links share (a hub, the least node of a component) are sides of joins, which Spark splits, or are aggregated before they are shuffled.

Rounds: those of chains, cycles and trees grow with the logarithm of their length. In other graphs without cycles a round of
trimming takes off one layer, so deep meshes take as many rounds as they have layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.lineage import written

#: Numbers of nodes are below 2**BITS.
BITS = 40


def links_of(numbers: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (source, target, ...) whose ends both are in numbers (id, number), with their numbers a and b."""
    a, b = (numbers.select(F.col("id").alias(end), F.col("number").alias(to)) for end, to in (("source", "a"), ("target", "b")))
    return edges.join(a, "source").join(b, "target")


def _none(rows: DataFrame) -> bool:
    return rows.limit(1).count() == 0


def weak(links: DataFrame) -> DataFrame:
    """(number, root): the least node of each linked node's weak component, by alternating large and small stars.

    A large star hangs a node's greater neighbours below its least one, a small star the rest, until every node hangs directly
    below its root. A node without a link to another isn't in the result."""
    tree = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = tree.union(tree.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        tree = written(small.where("u <> v").distinct())
        ends = tree.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(tree.select("v", F.lit(0), F.lit(1)))
        if _none(ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")):
            return tree.select(F.col("u").alias("number"), F.col("v").alias("root")).union(tree.select("v", "v").distinct())


def reaching(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(number, label): the least node that reaches each of nodes (number) along links, itself included.

    In a round a node asks the sources of its links, the node of its label (what reaches that reaches the node as well), and, if
    it has a single source, a pointer along single sources, which doubles its length each time."""
    links = written(links.where("a <> b").select("a", "b").distinct())
    single = links.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("jump")).where("n = 1").select(F.col("b").alias("number"), "jump")
    state = written(nodes.select("number").distinct().join(single, "number", "left").select("number", F.col("number").alias("label"), "jump"))
    none = F.lit(None).cast("long")
    while True:
        asked = links.select(F.col("a").alias("of"), F.col("b").alias("number"), F.lit(False).alias("far"))
        asked = asked.union(state.where("jump IS NOT NULL").select("jump", "number", F.lit(True))).union(state.where("label <> number").select("label", "number", F.lit(False)))
        told = asked.join(state.select(F.col("number").alias("of"), "label", F.col("jump").alias("further")), "of")
        told = told.select("number", "label", F.when(F.col("far"), F.coalesce("further", "of")).alias("jump"), none.alias("before"))
        own = state.select("number", "label", none, F.col("label"))
        after = written(told.union(own).groupBy("number").agg(F.min("label").alias("label"), F.max("jump").alias("jump"), F.max("before").alias("before")))
        state = after.select("number", "label", "jump")
        if _none(after.where("label < before")):
            return state.select("number", "label")


def _mixed(number: Column, turn: int) -> Column:
    """Another number below 2**BITS for each, no two alike, in an order that differs from turn to turn: the bits from last to first, some turned over."""
    bits = F.reverse(F.lpad(F.bin(number), BITS, "0"))
    return F.conv(bits, 2, 10).cast("long").bitwiseXOR(F.lit((0x9E3779B97F4A7C15 * (turn + 1)) >> 7 & ((1 << BITS) - 1)))


def _squeezed(links: DataFrame, chains: list[DataFrame], found: list[DataFrame]) -> DataFrame:
    """links without nodes that nothing reaches or that lead nowhere, chains of nodes with one link in and out replaced by one link.

    chains gets (number, first, last) of the nodes of chains, found gets (number, root) of cycles that are nothing but a chain."""
    while True:
        core = written(links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        into = core.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("first")).where("n = 1").select(F.col("b").alias("number"), "first")
        out = core.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("last")).where("n = 1").select(F.col("a").alias("number"), "last")
        single = written(into.join(out, "number"))
        if _none(single):
            if core.count() == links.count():
                return core
            links = core
            continue
        runs, unended = single, -1
        while True:  # pointers double; each round some of the last ones of a chain end, so if none does, the rest are on cycles
            ahead = runs.select(F.col("number").alias("first"), F.col("first").alias("first2"), F.lit(1).alias("on1"))
            behind = runs.select(F.col("number").alias("last"), F.col("last").alias("last2"), F.lit(1).alias("on2"))
            runs = written(runs.join(ahead, "first", "left").join(behind, "last", "left").select("number", F.coalesce("first2", "first").alias("first"), F.coalesce("last2", "last").alias("last"), (F.coalesce("on1", F.lit(0)) + F.coalesce("on2", F.lit(0))).alias("on")))
            before, unended = unended, runs.agg(F.coalesce(F.sum("on"), F.lit(0))).first()[0]
            if unended in (0, before):
                break
            runs = runs.select("number", "first", "last")
        if unended:
            cycles = single.join(runs.where("on > 0").select("number"), "number", "left_semi")
            found.append(reaching(cycles, cycles.select(F.col("first").alias("a"), F.col("number").alias("b"))).select("number", F.col("label").alias("root")))
        ended = runs.where("on = 0").select("number", "first", "last")
        chains.append(ended)
        rest = core.join(single.select(F.col("number").alias("a")), "a", "left_anti").join(single.select(F.col("number").alias("b")), "b", "left_anti").select("a", "b")
        links = written(rest.union(ended.where("first <> last").select("first", "last")).distinct())


def strong(links: DataFrame) -> DataFrame:
    """(number, root): one node of the strong component of each node on a cycle of two or more; root may be absent as a number itself.

    What lies on no cycle is trimmed and chains become one link. Of the rest each node takes the least node that reaches it as its
    colour, in an order that is mixed anew each time; those that reach it back within the colour are its component and go. A chain belongs
    to the component of its ends if that is the same one."""
    left = written(links.where("a <> b").select("a", "b").distinct())
    chains: list[DataFrame] = []
    found: list[DataFrame] = []
    turn = 0
    while True:
        left = _squeezed(left, chains, found)
        if _none(left):
            break
        mixed = written(left.select(_mixed(F.col("a"), turn).alias("a"), _mixed(F.col("b"), turn).alias("b"), F.col("a").alias("a0"), F.col("b").alias("b0")))
        named = mixed.select(F.explode(F.array(F.struct(F.col("a").alias("number"), F.col("a0").alias("name")), F.struct(F.col("b").alias("number"), F.col("b0").alias("name")))).alias("e")).select("e.*").distinct()
        colour = reaching(named, mixed)
        within = written(mixed.join(colour.select(F.col("number").alias("a"), "label"), "a").join(colour.select(F.col("number").alias("b"), F.col("label").alias("label2")), "b").where("label = label2").select("a", "b", "a0", "b0"))
        back = reaching(named, within.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("label", "back")
        taken = colour.join(back, "number").where("label = back").join(named, "number")
        root = named.select(F.col("number").alias("label"), F.col("name").alias("root"))
        taken = written(taken.join(root, "label").select(F.col("name").alias("number"), "root"))
        found.append(taken)
        gone = taken.select("number")
        left = written(within.select(F.col("a0").alias("a"), F.col("b0").alias("b")).join(gone.withColumnRenamed("number", "a"), "a", "left_anti").join(gone.withColumnRenamed("number", "b"), "b", "left_anti").select("a", "b"))
        turn += 1
    roots = links.sparkSession.createDataFrame([], "number long, root long")
    for part in found:
        roots = roots.union(part)
    roots = written(roots)
    for part in reversed(chains):
        ends = part.join(roots.select(F.col("number").alias("first"), F.col("root").alias("r1")), "first", "left").join(roots.select(F.col("number").alias("last"), F.col("root").alias("r2")), "last", "left")
        ends = ends.select("number", F.coalesce("r1", "first").alias("root"), F.coalesce("r2", "last").alias("other")).where("root = other").select("number", "root")
        roots = written(roots.union(ends))
    return roots
