"""Prefix trie of conversations: what many conversations begin with, and how many words sharing it saves.

A node of depth d stands for a distinct sequence of d turns; the root for none. Conversations that begin with it are its
members, and the smallest one owns it. As a node's members are among those of the node above, what a conversation owns is a
suffix of its path, told by one number: the depth at which it begins. So no tree is ever walked. Windows over prefixes mark
the owned nodes; then each conversation adds to every node on its path what it reads below it (its occurrence words) less what it
owns below it, whether it ends in a leaf that it owns, and whether it owns the next node. One grouping by prefix sums that up.

Prefixes are told apart by 120 bits: SHA-256 of each turn with its depth, combined by exclusive or, which is associative. Long
conversations are therefore taken in blocks of BLOCK turns, whose totals are carried over, and no window holds more than a block.
The window that marks owners asks for first rows only, so each task passes on one row of a prefix, however many share it, and
sums are made before prefixes meet. Lists of members that end at a node are joined in runs of BLOCK ids and hashed as a stream.

Nulls: a null turn comes first, null role and text are empty, rows without a conversation's id are left out. Turns of equal
number are ordered by a digest of role and text, so repeated rows are turns of their own, next to each other. Texts
are hashed once, where they are read, and go no further, so their length matters nowhere else. An empty table has no conversation
and no nodes. Columns other than those four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import common

#: Turns of a block; conversation ids of a run.
BLOCK = 1024
#: A word of a turn. Every GROUP conversations share the first turns of the first of them, less than HEADS.
WORD, GROUP, HEADS = r"[^\x20\x09-\x0D]+", 20, 4
NODE = ["depth", "a", "b"]


def turns(table: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words) of each turn: at counts from 1 in the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    read = table.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    read = read.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    placed = read.withColumn("at", F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "digest")).cast("long"))
    before = _before(read.groupBy("conv_id", "block").agg(F.count("*").alias("n")), {"n": F.sum})
    return placed.join(before, ["conv_id", "block"]).select("conv_id", (F.col("at") + F.col("n")).alias("at"), "digest", "words")


def _before(blocks: DataFrame, sums: dict) -> DataFrame:
    """Each block's columns summed up over the conversation's blocks before it; one row for each BLOCK turns."""
    over = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select("conv_id", "block", *[F.coalesce(f(c).over(over), F.lit(0)).cast("long").alias(c) for c, f in sums.items()])


def shared(conv_id: Column) -> Column:
    """How many turns a conversation has from the first one of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words) of the turns of every conversation with its group's beginning in place of its own; and (conv_id, length)."""
    convs = read.groupBy("conv_id").agg(F.max("at").alias("own")).withColumns({"h": shared(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("of_base", F.lit(0)))).select("conv_id", "base", "own", "h", "given")
    heads = read.where(F.col("at") < HEADS).withColumnRenamed("conv_id", "base")
    first = convs.where("given > 0").join(heads, "base").where("at <= given").select("conv_id", F.col("at").alias("depth"), "digest", "words")
    rest = read.join(convs, "conv_id").where("at > h").select("conv_id", (F.col("given") + F.col("at") - F.col("h")).alias("depth"), "digest", "words")
    return first.unionByName(rest), convs.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def paths(table: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 0: conv_id, depth, the prefix (a, b), the one above (up_a, up_b), words of the path from here on (below), length."""
    made, lengths = rebuilt(common.stored(turns(table)))
    mark = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")), 256)
    bits = lambda at: F.conv(F.substring("mark", at, 15), 16, 10).cast("long")  # noqa: E731  sixty of them
    steps = made.withColumn("mark", mark).select("conv_id", "depth", F.floor(F.col("depth") / BLOCK).alias("block"), bits(1).alias("x"), bits(21).alias("y"), "words")
    steps = steps.unionByName(lengths.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "block", "x", "y", "words")]))
    before = _before(steps.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("xs"), F.bit_xor("y").alias("ys"), F.sum("words").alias("ws")), {"xs": F.bit_xor, "ys": F.bit_xor, "ws": F.sum})
    over = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = steps.withColumns({"rx": F.bit_xor("x").over(over), "ry": F.bit_xor("y").over(over), "rw": F.sum("words").over(over)})
    whole = lengths.join(steps.groupBy("conv_id").agg(F.sum("words").alias("all")), "conv_id")
    a, b = F.col("rx").bitwiseXOR(F.col("xs")), F.col("ry").bitwiseXOR(F.col("ys"))
    found = run.join(before, ["conv_id", "block"]).join(whole, "conv_id")
    return found.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"), (F.col("all") - F.col("rw") - F.col("ws") + F.col("words")).alias("below"), "length")


def trie(table: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path = common.stored(paths(table))
    first = F.row_number().over(W.partitionBy(*NODE).orderBy("conv_id"))
    owned = path.withColumn("n", first).where("n = 1")
    # where a conversation's own suffix begins, and the node above that place
    begin = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "up_a", "up_b", "below", "length")).alias("s"))
    begin = common.stored(begin.select("conv_id", "s.*"))
    forks = begin.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct()
    # who owns the last node of its path is its leaf's owner, unless others go on there: they begin just below
    last = path.where("depth = length").join(begin.select("conv_id"), "conv_id", "left_semi")
    leaves = last.join(forks, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    mark = begin.select("conv_id", F.col("depth").alias("own"), F.col("below").alias("own_below")).join(leaves, "conv_id", "left")
    seen = path.join(mark, "conv_id", "left")
    own = F.coalesce("own", F.col("length") + 1)
    nodes = seen.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((own <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))).cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
        F.sum(F.col("below") - F.when(own <= F.col("depth"), F.col("below")).otherwise(F.coalesce("own_below", F.lit(0)))).alias("saved_tokens"),
    )
    nodes = common.stored(nodes)
    # only at the beginning of its suffix has a conversation's node a parent of another owner
    entries = begin.where("depth > 0").select(F.col("conv_id").alias("child"), F.col("depth").alias("at"), (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    parents = entries.join(nodes.select(*NODE, F.col("conv_id").alias("parent")), NODE).select(F.col("child").alias("conv_id"), F.col("at").alias("depth"), "parent")
    ends = ends_digest(path.where("depth = length").select(*NODE, "conv_id"))
    out = nodes.join(parents, ["conv_id", "depth"], "left").join(ends, NODE, "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the conversations (conv_id) that end at a node: their ids joined in runs, the runs hashed one after another."""
    run = F.floor(F.col("conv_id") / BLOCK).alias("run")
    joined = ends.groupBy(*NODE, run).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, made = None, None, []
        for batch in batches:
            for node, ids in zip(zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column("ids").to_pylist()):
                if node == held:
                    state.update(b",")
                else:
                    if held is not None:
                        made.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(made)
            made = []
        if held is not None:
            yield _digests([(*held, state.hexdigest())])

    dealt = joined.repartition(*NODE).sortWithinPartitions(*NODE, "run").select(*NODE, "ids")
    return dealt.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _digests(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=[*NODE, "ends_sha256"])


def oracle(table: str = "conversations") -> str:
    """DuckDB SQL for the rows of trie()."""
    return rf"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(256) r(i)
),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM {table} WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, own,
    xor(4294967295, list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1]), 4294967295::BIGINT)) % 4 AS h
  FROM (SELECT conv_id, max(pos) AS own FROM turns GROUP BY conv_id), crc_table
),
sized AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS given FROM convs c LEFT JOIN convs b ON c.base = b.conv_id),
rebuilt AS (
  SELECT s.conv_id, t.pos AS depth, role, text FROM sized s JOIN turns t ON t.conv_id = s.base AND t.pos <= s.given
  UNION ALL SELECT s.conv_id, s.given + t.pos - s.h, role, text FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.pos > s.h
),
steps AS (
  SELECT conv_id, depth, text, sha256(depth || ':' || length(role) || ':' || role || text) AS mark FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', '' FROM sized
),
prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS p, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    max(depth) OVER (PARTITION BY conv_id) AS length FROM steps
),
linked AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM prefixes),
nodes AS (
  SELECT p, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM linked GROUP BY p
),
marked AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.up = n.p) AS n_children FROM nodes n),
subtrees AS (
  SELECT l.p, sum(m.saved) AS saved, count(*) FILTER (m.n_children = 0) AS leaves
  FROM (SELECT DISTINCT l.p, d.p AS below FROM linked l JOIN linked d ON l.conv_id = d.conv_id AND d.depth >= l.depth) l JOIN marked m ON l.below = m.p GROUP BY l.p
)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM marked m JOIN subtrees s ON m.p = s.p LEFT JOIN nodes u ON m.up = u.p"""
