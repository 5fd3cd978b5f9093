"""Repeated passages by a depth-limited radix sort of suffixes.

Two suffixes are equal to the depth of LENGTH tokens exactly if the same string of LENGTH tokens, a window, starts at both;
such windows repeat. The sort goes by digits, the most significant first, every group in the same way whatever its size, and
a suffix leaves it as soon as it is alone or known to be equal to another to full depth:

1. The first digit is a gram within the window: the one of least hash, the leftmost of equal ones, which is the same in equal
   windows wherever they stand. Windows side by side that have the same gram are one unit, so that one row is dealt out for
   about GRAM tokens and a gram that stands once ends the matter.
2. The second digit is the unit's whole content with the gram's place in it: units that agree in it agree in all windows.
3. Grams with several contents are left, at the edges of passages. Their windows are divided by their offset to the gram into
   blocks of WIDTHS[0] offsets. A block's digit is the core, what all its windows have in common: if it stands in no other
   unit, none of its windows does. If all that the block's windows cover stands elsewhere, they all do. Only blocks in between
   are divided, into blocks of the next width, at last into single windows, whose digit is the window itself.

All groups are counted by aggregation, hot ones too: no task gathers a group, and rows follow the number of units. A digit is
a 64-bit polynomial hash within a gram, itself such a hash; a content is known by its gram and an xxh3 digest of its bytes.
So equality is one of 128 bits from two kinds of hashes, at which 10**12 units have a false match with a chance of 10**-14.

Rows of equal texts are one text for the sort: such a text repeats as a whole. Two kinds of tokens go through the same
passes: bytes, whose repeated windows are removed, and words (of 51 and more, by exact bytes between white space), of which
it is only asked whether a window also stands in another document.

Nulls: a null text counts as empty, a null id stays null. Empty and short texts keep all bytes. Repeated rows are copies, so
their strings repeat, and each is another document. Ties between equal grams go to the leftmost. Very long texts are cut into
chunks that overlap by a window. An empty table gives an empty result. Columns other than the id's and the text are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common


@dataclass(frozen=True)
class Kind:
    """Tokens: their number, that of a window and of a gram, the bytes of a token."""

    number: int
    length: int
    gram: int
    size: int

    @property
    def reach(self) -> int:
        """A window begins at most so many tokens before its gram."""
        return self.length - self.gram


BYTES, WORDS = KINDS = (Kind(0, 400, 64, 1), Kind(1, 51, 8, 8))
#: Widths of the blocks of offsets; each divides the one before.
WIDTHS = (36, 6, 1)
#: Tokens whose windows are worked on at once.
CHUNK = 1 << 20
#: White space between words, as bytes. Fixed values.
SPACES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
IS_SPACE = np.isin(np.arange(256), SPACES)
#: A gram's last bit is the number of its kind.
UNIT = ["gram", "context"]
DOC = ["doc", "doc2"]


def anchors(grams: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each gram that is the least of a window, the leftmost of equal ones, and the windows of which it is."""
    width = reach + 1
    windows = len(grams) - reach
    blocks = -(-len(grams) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(grams)] = grams
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[reach : len(grams)])  # of each window
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # where runs of windows of the same least begin
    last = np.concatenate([first[1:], [windows]]) - 1
    at = first + reach  # right where the least becomes less: the gram has just come in
    seek = np.flatnonzero(np.concatenate([[True], least[first[1:]] > least[first[1:] - 1]]))
    at[seek] = first[seek] + np.lib.stride_tricks.sliding_window_view(grams, width)[first[seek]].argmin(1)
    again = last > at  # the least occurs again, as in repeated lines
    parts = [(at[~again], first[~again], last[~again])]
    for i in np.flatnonzero(again).tolist():
        same = first[i] + np.flatnonzero(grams[first[i] : last[i] + width] == least[first[i]])
        same = same[np.searchsorted(same, first[i]) : np.searchsorted(same, last[i]) + 1]
        parts.append((same, np.concatenate([[first[i]], same[:-1] + 1]), np.minimum(same, last[i])))
    return tuple(np.concatenate(x) for x in zip(*parts))


def words_of(data: np.ndarray) -> np.ndarray:
    """The hashes of a text's words."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = IS_SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    parts = []
    for a in range(0, len(starts), CHUNK // 8):
        s, e = starts[a : a + CHUNK // 8], ends[a : a + CHUNK // 8]
        parts.append(hashes_of(data[s[0] : e[-1]]).of(s - s[0], e - s[0]))
    return common.joined(parts, np.uint64)


def tokens_of(data: np.ndarray, kind: Kind) -> np.ndarray:
    return data if kind == BYTES else words_of(data)


def hashes_of(tokens: np.ndarray) -> common.RunHashes:
    return common.RunHashes(tokens.astype(np.uint64) + np.uint64(1))


def digest(content: memoryview | bytes, before: int) -> int:
    """What a unit's content is known by, along with its gram."""
    return xxhash.xxh3_64_intdigest(content, before)


def units(tokens: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """(gram, context, place, before, span) of a text's units: before tokens of the content stand before the gram, span + 1 windows begin in it."""
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(tokens) - kind.length + 1, CHUNK):
        part = np.ascontiguousarray(tokens[a : a + CHUNK + kind.length - 1])
        grams = hashes_of(part).fixed(kind.gram)
        at, first, last = anchors(grams, kind.reach)
        raw, size = memoryview(part.view(np.uint8)), kind.size
        before = at - first
        contexts = [digest(raw[s * size : (t + kind.length) * size], b) for s, t, b in zip(first.tolist(), last.tolist(), before.tolist())]
        found.append(((grams[at] & ~np.uint64(1)) | np.uint64(kind.number), np.array(contexts, np.uint64), at + a, before, last - first))
    if not found:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*found))


def digits(rows: DataFrame) -> DataFrame:
    """A row for each text (doc, doc2, text) and distinct unit: the first place with before and span, packed, and all places of bytes if there are several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                for kind in KINDS:
                    if len(data) >= kind.length:
                        got = units(tokens_of(data, kind), kind)
                        owner.append(np.full(len(got[0]), i))
                        found.append(got)
            o = common.joined(owner, np.int64)
            if not len(o):
                continue
            g, c, p, b, s = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((p, c, g, o))
            o, g, c, p, b, s = (x[order] for x in (o, g, c, p, b, s))
            new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
            times = np.diff(np.concatenate([new, [len(o)]]))
            several = (times > 1) & (g[new] & np.uint64(1) == BYTES.number)
            sizes = np.where(several, times, 0)
            used = np.repeat(several, times)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            listed = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(p[used].astype("<u4").tobytes())])
            packed = p[new] << 20 | b[new] << 10 | s[new]
            at = pa.array(o[new])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[new].view(np.int64)), pa.array(c[new].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(packed), listed],
                names=["gram", "context", "doc", "doc2", "packed", "places"],
            )

    return rows.mapInArrow(common.frugal(run), "gram long, context long, doc long, doc2 long, packed long, places binary")


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted units (doc, rep, gram, context, a, b, packed), by the row of id rep, with their content's tokens as bytes."""
    names = ["gram", "context", "a", "b"]
    grouped = wanted.groupBy("doc", "rep").agg(F.collect_list(F.struct(*names, "packed")).alias("w"))  # as many as a document has units
    joined = rows.join(grouped, (rows["doc"] == grouped["doc"]) & rows["id"].eqNullSafe(grouped["rep"])).select("text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            each = asked.flatten()
            ends = np.cumsum(np.diff(asked.offsets.to_numpy()))
            packed = each.field("packed").to_numpy()
            before, span = packed >> 10 & 1023, packed & 1023
            first = ((packed >> 20) - before).tolist()
            known = each.field("context").to_numpy().view(np.uint64).tolist()
            numbers = (each.field("gram").to_numpy() & 1).tolist()
            out, at, done = [], [], 0
            for text, end in zip(batch.column(0).to_pylist(), ends.tolist()):
                data = np.frombuffer(text.encode(), np.uint8)
                held = {}
                for i in range(done, end):
                    kind = KINDS[numbers[i]]
                    if kind not in held:
                        held[kind] = memoryview(tokens_of(data, kind).view(np.uint8))
                    content = held[kind][first[i] * kind.size : (first[i] + int(span[i]) + kind.length) * kind.size]
                    if digest(content, int(before[i])) == known[i]:  # else a text of the same doc, but not of the same doc2
                        out.append(bytes(content))
                        at.append(i)
                done = end
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(each.field(n).take(index) for n in names), pa.array(before[at].astype(np.int16)), pa.array(span[at].astype(np.int16)), common.packed(out)], names=[*names, "before", "span", "content"])

    return joined.mapInArrow(common.frugal(run), "gram long, context long, a long, b long, before short, span short, content binary")


BLOCKS = "gram long, context long, a long, b long, lo short, hi short, core long, whole long"


def divided(nodes: DataFrame, width: int) -> DataFrame:
    """The blocks of `width` offsets of units (with content and parents, the ranges of offsets that are open), with the hashes of core and whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy() & 1
            for kind in KINDS:
                own = np.flatnonzero(numbers == kind.number)
                if not len(own):
                    continue
                part = batch.take(pa.array(own))
                gram, context, a, b, before, contents, parents = part.columns
                content = contents.to_pylist()
                starts = np.cumsum([0, *map(len, content)]) // kind.size
                hashes = hashes_of(np.frombuffer(b"".join(content), np.uint8 if kind == BYTES else np.uint64))
                ranges = parents.flatten()
                unit = np.repeat(np.arange(len(own)), np.diff(parents.offsets.to_numpy()))
                low, high = (ranges.field(n).to_numpy().astype(np.int64) for n in ("lo", "hi"))
                times = high // width - low // width + 1
                block = np.repeat(low // width, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                unit, low, high = np.repeat(unit, times), np.repeat(low, times), np.repeat(high, times)
                lo, hi = np.maximum(low, block * width), np.minimum(high, block * width + width - 1)
                zero = starts[unit] + before.to_numpy().astype(np.int64)[unit]  # where the gram stands
                core = hashes.of(zero - block * width, zero + kind.length - (block * width + width - 1))
                core ^= common.mixed(block.astype(np.uint64) << np.uint64(8) | np.uint64(width))
                whole = hashes.of(zero - hi, zero - lo + kind.length) ^ common.mixed(lo.astype(np.uint64) << np.uint64(16) | hi.astype(np.uint64))
                at = pa.array(unit)
                yield pa.RecordBatch.from_arrays(
                    [*(x.take(at) for x in (gram, context, a, b)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["gram", "context", "a", "b", "lo", "hi", "core", "whole"],
                )

    return nodes.select("gram", "context", "a", "b", "before", "content", "parents").mapInArrow(common.frugal(run), BLOCKS)


def passes(contexts: DataFrame) -> DataFrame:
    """(gram, context, lo, hi): the ranges of offsets whose windows stand in other units too.

    a and b of a unit are the least and the greatest of its owners; a class is repeated if its units have different ones."""
    nodes = contexts.withColumn("parents", F.array(F.struct((F.col("before") - F.col("span")).cast("short").alias("lo"), F.col("before").alias("hi"))))
    hits = None
    for width in WIDTHS:
        rows = common.stored(divided(nodes, width))
        classes = rows.groupBy("gram", "core", "whole").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("context").alias("one"))
        cores = classes.groupBy("gram", "core").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.count("*").alias("n")).where("least <> most").select("gram", "core", "n")
        alive = classes.join(cores, ["gram", "core"]).select("gram", "core", "whole", (F.col("a") != F.col("b")).alias("all"), "one", "n")
        # of units that agree in a repeated block one goes on, beside others of that core, which may share a part of it
        on = (F.col("n") > 1) & (~F.col("all") | (F.col("context") == F.col("one")))
        found = common.stored(rows.join(alive, ["gram", "core", "whole"]).select(*UNIT, "lo", "hi", "all", on.alias("on")).where("all OR on"))
        common.released(rows)
        hit = found.where("all").select(*UNIT, "lo", "hi")
        hits = hit if hits is None else hits.unionByName(hit)
        if width != WIDTHS[-1]:
            left = found.where("on").groupBy(*UNIT).agg(F.collect_list(F.struct("lo", "hi")).alias("parents"))  # as many as a unit has blocks
            nodes = contexts.join(left, UNIT)
    return hits


def marked(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, doc2, packed, places, runs): units of bytes with windows that repeat, all of them if runs is null; and (doc, doc2)
    of the texts that have a window of words which another one has. keyed: id, doc, doc2, text."""
    words = (F.col("gram").bitwiseAND(1)) == WORDS.number
    first = common.stored(digits(keyed.select(*DOC, "text")))
    # grams that stand once, or only in copies of a text, end the matter here
    live = first.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min("context").alias("c1"), F.max("context").alias("c2"), F.max(F.length("places")).alias("n"))
    live = live.where((F.col("a") != F.col("b")) | (~words & ((F.col("c1") != F.col("c2")) | (F.col("n") > 0)))).select("gram", (F.col("c1") != F.col("c2")).alias("split"))
    active = common.stored(first.join(live, "gram"))
    common.released(first)
    contexts = active.groupBy(*UNIT).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max(F.length("places")).alias("n"), F.min_by("packed", "doc").alias("packed"), F.max("split").alias("split"))
    repeated = (F.col("a") != F.col("b")) | (F.col("n") > 0)
    contexts = common.stored(contexts.select(*UNIT, "a", "b", "packed", "split", repeated.alias("repeated")).where("split OR repeated"))
    reps = keyed.groupBy(*DOC).agg(F.min("id").alias("rep")).drop("doc2")
    # bytes: units are their own owners, for windows may repeat within a text
    own = lambda c: F.when(words, F.col(c)).otherwise(F.col("context")).alias(c)
    wanted = contexts.where("split").withColumn("doc", F.col("a")).join(reps, "doc").select("doc", "rep", *UNIT, own("a"), own("b"), "packed")
    held = common.stored(fetched(keyed, wanted))
    common.tidied(keyed.sparkSession)
    hits = passes(held)
    whole = contexts.where("repeated").select(*UNIT, F.lit(True).alias("whole"))
    runs = hits.groupBy(*UNIT).agg(F.collect_list(F.col("lo").cast("int") * 1024 + F.col("hi")).alias("runs"))
    marks = whole.join(runs, UNIT, "full").select(*UNIT, F.when(F.col("whole").isNull(), F.col("runs")).alias("runs"))
    joined = common.stored(active.join(marks, UNIT).select("gram", *DOC, "packed", "places", "runs"))
    common.released(active)
    common.released(held)
    common.tidied(keyed.sparkSession)
    return joined.where(~words).drop("gram"), joined.where(words).select(*DOC).distinct()


def removed(docs: DataFrame, doc_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_columns, n_bytes, spans (array of start, end in bytes, maximal), kept (binary) and repeats_passage of each row.

    repeats_passage: does a run of over 50 words of the text also stand in another document?"""
    common.small_batches(docs.sparkSession)
    # a text is known by two hashes; rows of equal texts share them
    base = docs.select(*doc_columns, common.clean_text().alias("text"))
    keyed = base.select(F.col(doc_columns[0]).alias("id"), F.xxhash64("text").alias("doc"), F.xxhash64(F.lit(2), F.col("text")).alias("doc2"), *[F.col(c).alias(f"own_{i}") for i, c in enumerate(doc_columns)], "text")
    marks, flagged = marked(keyed.select("id", *DOC, "text"))
    copied = keyed.groupBy(*DOC).agg(F.count("*").alias("n")).where("n > 1").select(*DOC)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, at, r in zip(*(c.to_pylist() for c in batch.columns[2:])):
                place = np.frombuffer(at, "<u4").astype(np.int64) if at else np.array([packed >> 20])
                before = packed >> 10 & 1023
                pairs = np.array([(before - (packed & 1023), before)] if r is None else [divmod(x, 1024) for x in r], np.int64)
                out.append(np.stack([(place[:, None] - pairs[:, 1]).ravel(), (place[:, None] - pairs[:, 0] + BYTES.length).ravel()], 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], common.packed(out)], names=[*DOC, "cuts"])

    cuts = marks.select(*DOC, "packed", "places", "runs").mapInArrow(common.frugal(spread), "doc long, doc2 long, cuts binary")
    none, yes, no = F.lit(None).cast("binary").alias("cuts"), F.lit(True), F.lit(False)
    both = cuts.select("*", no.alias("flag"), no.alias("copied")).unionByName(flagged.select(*DOC, none, yes.alias("flag"), no.alias("copied"))).unionByName(copied.select(*DOC, none, no.alias("flag"), yes.alias("copied")))
    both = both.groupBy(*DOC).agg(F.collect_list("cuts").alias("cuts"), F.max("flag").alias("flag"), F.max("copied").alias("copied"))  # as many as a document has units
    n = len(doc_columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans_, kept, flags = [], [], [], []
            for text, lists, flag, copy in zip(*(c.to_pylist() for c in batch.columns[n:])):
                data = text.encode()
                change = np.zeros(len(data) + 1, np.int32)
                if lists:
                    pairs = np.frombuffer(b"".join(lists), "<u4").astype(np.int64).reshape(-1, 2)
                    np.add.at(change, pairs[:, 0], 1)
                    np.add.at(change, pairs[:, 1], -1)
                if copy and len(data) >= BYTES.length:
                    change[0] += 1
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                sizes.append(len(data))
                spans_.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if len(edges) else data)
                flags.append(bool(flag) or bool(copy) and len(words_of(np.frombuffer(data, np.uint8))) >= WORDS.length)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(spans_, kind), common.packed(kept), pa.array(flags, pa.bool_())], names=[*doc_columns, "n_bytes", "spans", "kept", "repeats_passage"])

    joined = keyed.join(both, DOC, "left").select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(doc_columns)], "text", "cuts", "flag", "copied")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in doc_columns)
    return joined.mapInArrow(common.frugal(cut), f"{fields}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, repeats_passage boolean")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats_passage of each document."""
    out = removed(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "repeats_passage")
