"""Near-duplicate documents by bag MinHash: weighted-Jaccard signatures, bands, and a check of the multiset overlap.

A document is the multiset of its runs of five words (lower case, between white space). For each shingle there are Poisson
processes in time, one for each octave [0,1), [1,2), [2,4), [4,8) ... of the weight axis, with a rate equal to the octave's
length. Each point has a place in its octave and one of the signature's components. A document takes the points that lie
below its shingle's multiplicity; a component keeps its earliest point. Two documents agree in a component with a
probability of exactly their weighted Jaccard similarity. Points are drawn in order of time and a process ends once it is
later than all components, so that a signature costs about as many points as the document has shingles.

Equal texts are one node. Nodes with an equal band of the signature meet in a bucket. Shingles that no other of the nodes
in buckets has are a node's own. They bound its similarity to all others: a node of which over a fifth is its own has no
link. Each bucket's nodes are compared with the one that has the least share of its own; this joins large groups without
their pairs. What isn't joined then is compared exactly: two nodes of a bucket that are in different components need a
comparison only if the sums of their other shingles, by groups of hashes, allow a link and their distances to the centre differ by no more than
the threshold, for the distance is a metric. So no link between nodes that share a bucket is lost. Classes are the
connected components of the verified links. Bands miss a link of exactly the threshold once in 1,500 times, and one of
0.9 in similarity once in 10**8.

Nulls: a null text counts as empty. Texts without a word are classes of their own; texts of under five words are one
shingle. A null id stays null and is never the one that stands for its class, unless there is no other. Rows that repeat
are copies of each other. The tables may be empty and have more columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.bpe import WHITE_SPACE

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
SIZE = BANDS * ROWS
CHUNK = 500_000
#: Groups of shingles, by hash, whose sums bound what two texts can have in common.
GROUPS = 32
#: Points that all processes together draw in a step, if that is over one each.
POINTS = 150_000


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, multiplicity) of the texts' shingles, in order."""
    texts = [t.lower() for t in texts]
    whole = "\n".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    white = np.zeros(0x3001, bool)
    white[WHITE_SPACE] = True
    gap = np.ones(len(points) + 2, bool)
    gap[1:-1] = white[np.minimum(points, 0x3000)] & (points <= 0x3000)
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    words = common.RunHashes(points.astype(np.uint64) + np.uint64(1)).of(starts, ends)
    doc = np.searchsorted(np.cumsum(np.array([len(t) + 1 for t in texts])), starts, side="right")
    first = np.searchsorted(doc, doc)
    count = np.searchsorted(doc, doc, side="right") - first
    at = np.flatnonzero((np.arange(len(doc)) + WORDS <= first + count) | ((count < WORDS) & (np.arange(len(doc)) == first)))
    runs = common.RunHashes(words).of(at, at + np.minimum(WORDS, count[at]))
    keys = (doc[at].astype(np.uint64) << np.uint64(44)) | (runs >> np.uint64(20))
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), counts


def signatures(n: int, doc: np.ndarray, item: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The times of the earliest point in each component, for each of n documents; inf in those without a shingle."""
    out = np.full(n * SIZE, np.inf)
    top = int(weight.max(initial=1) - 1).bit_length()
    parts = []
    for octave in range(top + 1):
        low, high = (0, 1) if not octave else (1 << octave - 1, 1 << octave)
        has = np.flatnonzero(weight > low)
        part = (np.minimum(weight[has], high) - low) / (high - low)
        parts.append((doc[has], common.mixed(item[has] * np.uint64(64) + np.uint64(octave)), np.full(len(has), 1.0 / (high - low)), part))
    owner, seed, pause, limit = (np.concatenate(x) for x in zip(*parts))
    time, drawn = np.zeros(len(owner)), 0
    while len(owner):
        step = max(1, min(64, POINTS // len(owner)))
        number = np.arange(drawn, drawn + step, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        bits = common.mixed(seed[:, None] + number[None, :])
        waits = -np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53) * pause[:, None]
        waits[:, 0] += time
        times = np.cumsum(waits, axis=1)
        more = common.mixed(bits ^ np.uint64(0xA0761D6478BD642F))
        component = ((more >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)).astype(np.int64)
        component += owner[:, None] * SIZE
        if limit.min() < 1:
            inside = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < limit[:, None]
            np.minimum.at(out, component[inside], times[inside])
        else:
            np.minimum.at(out, component.ravel(), times.ravel())
        time = times[:, -1]
        drawn += step
        on = time < out.reshape(n, SIZE).max(1)[owner]
        owner, seed, pause, limit, time = owner[on], seed[on], pause[on], limit[on], time[on]
    return out.reshape(n, SIZE)


def bands(times: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; it tells the bands apart."""
    bits = times.view(np.uint64).reshape(len(times), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(ROWS):
        key = common.mixed(key * np.uint64(common.HASH_BASE) + bits[:, :, i])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted items, multiplicities)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands): the text's digest and band keys, both null if it has no word."""
    common.small_batches(docs.sparkSession)
    text = common.clean_text()
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("node"), text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in common.text_chunks(texts, CHUNK):
                doc, item, weight = shingles(texts[a:b])
                empty = np.ones(b - a, bool)
                empty[doc] = False
                keys = bands(signatures(b - a, doc, item, weight))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                part = batch.slice(a, b - a)
                live = pa.array(~empty)
                none = pa.nulls(b - a, pa.binary()), pa.nulls(b - a, lists.type)
                node = pc.if_else(live, part.column(1).cast(pa.binary()), none[0])
                yield pa.RecordBatch.from_arrays([part.column(0), node, pc.if_else(live, lists, none[1])], names=["doc_id", "node", "bands"])

    return rows.mapInArrow(common.frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            known = dict(zip(a, x)) | dict(zip(b, y))
            names, bags = list(known), {}
            for i, j in common.text_chunks(texts_ := [known[k] for k in names], CHUNK):
                doc, item, weight = shingles(texts_[i:j])
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                bags |= {names[i + k]: (item[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]) for k in range(j - i)}
            values = [overlap(bags[p], bags[q]) for p, q in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(values, pa.float64())], names=["a", "b", "s"])

    return both.mapInArrow(common.frugal(run), "a binary, b binary, s double")


def own_parts(texts: DataFrame) -> DataFrame:
    """(node, size, own, held): a text's shingles, those that stand in no other of the texts, and the others by hash group."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in common.text_chunks(values, CHUNK):
                doc, item, weight = shingles(values[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(item.view(np.int64)), pa.array(weight.astype(np.int32))], names=["node", "item", "weight"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in common.text_chunks(values, CHUNK):
                doc, item, weight = shingles(values[a:b])
                sums = np.bincount(doc * GROUPS + (item % np.uint64(GROUPS)).astype(np.int64), weight, (b - a) * GROUPS).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, GROUPS), pa.int32()), pa.array(sums))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["node", "total"])

    rows = texts.select("node", "text")
    items = rows.mapInArrow(common.frugal(listed), "node binary, item long, weight int")
    once = items.groupBy("item").agg(F.count("*").alias("n"), F.first("node").alias("node"), F.first("weight").alias("weight"))
    of = lambda g: F.coalesce(F.sum(F.when(F.pmod("item", F.lit(GROUPS)) == g, F.col("weight"))), F.lit(0).cast("long"))
    own = once.where("n = 1").groupBy("node").agg(F.sum("weight").alias("own"), F.array(*[of(g) for g in range(GROUPS)]).alias("alone"))
    both = rows.mapInArrow(common.frugal(grouped), "node binary, total array<long>").join(own, "node", "left")
    size = F.aggregate("total", F.lit(0).cast("long"), lambda x, y: x + y)
    held = F.when(F.col("alone").isNull(), F.col("total")).otherwise(F.zip_with("total", "alone", lambda x, y: x - y))
    return both.select("node", size.alias("size"), F.coalesce("own", F.lit(0).cast("long")).alias("own"), held.alias("held"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, node) and the roots (node, root) of nodes that are linked with others."""
    rows = common.checkpointed(signed(docs))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = common.checkpointed(nodes)
    held = nodes.select("node", F.explode("bands").alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    inside = common.checkpointed(held.join(shared, "key"))
    wanted = inside.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    source = docs.select("doc_id", common.clean_text().alias("text")).withColumn("node", F.unhex(F.md5("text")))
    # a null id can't be joined on by equality; such a node is found by its digest alone
    by_id = source.join(wanted.where("doc_id IS NOT NULL").select("doc_id", "node"), ["doc_id", "node"]).select("node", "text")
    texts = by_id.unionByName(source.where("doc_id IS NULL").join(wanted.where("doc_id IS NULL").select("node"), "node").select("node", "text"))
    texts = common.checkpointed(texts.dropDuplicates(["node"]))
    common.tidied(docs.sparkSession)  # shuffle files of what is kept by now
    able = common.checkpointed(own_parts(texts).where(F.col("own") <= (1 - SIMILARITY) * F.col("size") + 1e-9))
    inside = inside.join(able.select("node", (F.col("own") / F.col("size")).alias("share")), "node")
    centres = inside.groupBy("key").agg(F.min(F.struct("share", "node")).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.node").alias("centre"))
    met = common.checkpointed(inside.drop("share").join(centres, "key"))
    pairs = met.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    common.tidied(docs.sparkSession)
    first = common.checkpointed(compared(pairs, texts))
    common.tidied(docs.sparkSession)
    links = first.where(F.col("s") >= SIMILARITY).select("a", "b")
    roots = common.components(links)
    # the rest of each bucket: nodes of different components, one of them not linked with the centre
    near = met.join(first.withColumnsRenamed({"a": "node", "b": "centre"}), ["node", "centre"], "left").withColumn("d", 1 - F.coalesce("s", F.lit(1.0)))
    near = near.join(roots, "node", "left").select("key", "node", "d", F.coalesce("root", "node").alias("root"))
    apart = near.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("key")
    near = common.checkpointed(near.join(apart, "key").join(able.select("node", "size", "held"), "node"))
    out = near.where(F.col("d") > 1 - SIMILARITY)
    other = near.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "d", "root", "size", "held")])
    common_ = F.aggregate(F.zip_with("held", "held2", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)  # at best
    most = common_ / (F.col("size") + F.col("size2") - common_)
    rest = out.join(other, "key").where((F.col("root") != F.col("root2")) & (F.col("d2") > 0) & (F.abs(F.col("d") - F.col("d2")) <= 1 - SIMILARITY + 1e-9) & (most >= SIMILARITY - 1e-9))
    rest = rest.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = common.checkpointed(compared(rest.join(done, ["a", "b"], "left_anti"), texts).where(F.col("s") >= SIMILARITY).select("a", "b"))
    if not more.isEmpty():
        roots = common.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return rows.select("doc_id", "node"), roots


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size (rows) of each row."""
    rows, roots = linked(docs)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size")), "root").select("node", "class_id", "class_size")
    return rows.join(named, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least id, with all columns of docs; texts without a word all stay."""
    rows, roots = linked(docs)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("m")).select(F.col("m.least").alias("__id"), F.col("m.node").alias("__node"))
    keyed = docs.withColumn("__node", F.unhex(F.md5(common.clean_text())))
    wordless = F.trim(F.translate(common.clean_text(), "".join(map(chr, WHITE_SPACE)), "")) == ""
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    chosen = keyed.where(~wordless).join(kept, "__node").where(same).drop("__id").dropDuplicates(["__node"])
    return chosen.unionByName(keyed.where(wordless)).select(*[f"`{c}`" for c in docs.columns])
