"""Token files: id payloads in shards in the order of keys, each with a minimal perfect hash index for keyed access.

Documents are dealt out by ranges of their key and sorted; each task encodes what it gets and streams shards to the shared
folder, under names of their own, so that a task that runs again leaves no half file in use: only files that the manifest
names count. A shard is

    payload    ids of all its documents, one after another, as little-endian unsigned integers of 16 or 32 bits
    places     where each document begins in the payload, in ids, and the end: (documents + 1) x u64
    seeds      one for each bucket of the perfect hash: i32
    marks      fingerprint of the key in each slot, its first document, and how many have it: 3 x u32 a key
    footer     fixed size: numbers of documents, keys, documents without a key, buckets, ids; width of an id; a magic word

The index is hash and displace: keys fall into buckets, buckets are placed from the largest to the least by a displacement that
lands all their keys in free slots, and a bucket of one key names its slot. A look-up reads one seed, one slot, two places and
the payload, whatever the size of the shard. A key that isn't there is taken for another one with a chance of 2**-32.

Nulls: a null text counts as empty; rows with a null key come first, and a null key finds them. Empty texts have the end id
alone. Long texts are rows like others; a shard ends at the first document beyond its size. Rows with one key stand next to each
other, ordered by their text, may go on in later shards, and are all found by it, so ties and repeated rows lose nothing. An
empty table gives no shard and no rows. Columns other than key and text are ignored, whatever their names. Keys are integers.
"""

from __future__ import annotations

import atexit
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import common

#: Bytes of payload and documents at which a shard ends.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 19
#: Bytes of shards' key ranges that are sent to all tasks: 24 for each 64 MB of payload, so 30 MB for 100 TB of texts.
RANGE_BYTES = 256 << 20
#: Tasks that read at most; each has some whole shards.
READERS = 1 << 16
#: Keys a bucket, on average.
BUCKET_KEYS = 2
MAGIC = b"IDSHARD1"
FOOTER = struct.Struct("<QQQQQQ8s")
#: Words that are kept with their ids, and the longest of them.
CACHED, CACHED_LENGTH = 400_000, 40
#: Letters and signs beyond ASCII that normalisation changes in nothing but their case, one by one. Fixed values.
PLAIN_LETTERS = "À-ÖØ-öø-įı-ňŊ-ž"
PLAIN_SIGNS = "¡§«¶·»¿‘’“”„–—…€"
PLAIN = re.compile(f"[!-~{PLAIN_LETTERS}{PLAIN_SIGNS}]*")
#: What the tokenizer takes for separate words of such characters in lower case. Fixed values of the tokenizer's file.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{PLAIN_LETTERS}]+|[0-9]|[^a-z{PLAIN_LETTERS}0-9]+")
#: Bytes that stand for themselves in a byte-level vocabulary; the others are the letters from 256 on, in order.
OWN_LETTERS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in OWN_LETTERS)}


class WordEncoder:
    """Ids of texts by the tokenizers library. Words between blanks don't depend on each other in it, so each is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind, self.code = ("<u2", "H") if self.library.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the words before there were CACHED of them
        self.pieces: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def plain(self, word: str) -> bytes:
        """Of a word in PLAIN characters: its pieces go to the merges themselves, as nothing in it would be normalised but its case."""
        out = []
        for piece in PIECES.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.packed([x.id for x in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS))])
                if len(piece) <= CACHED_LENGTH:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def text(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            missing = [i for i, ids in enumerate(found) if ids is None]
            held = {w: self.older.get(w) for w in {words[i] for i in missing}}
            fresh = [w for w, ids in held.items() if ids is None]
            foreign = [w for w in fresh if PLAIN.fullmatch(w) is None or "<|" in w]  # special tokens stay the library's
            for w, e in zip(foreign, self.library.encode_batch_fast(foreign, add_special_tokens=False) if foreign else []):
                held[w] = self.packed(e.ids)
            for w in fresh:
                if held[w] is None:
                    held[w] = self.plain(w)
            for i in missing:
                found[i] = held[words[i]]
            if len(self.words) + len(held) > CACHED:
                self.words, self.older = {}, self.words
            if len(self.pieces) > CACHED:
                self.pieces = {}
            self.words.update((w, ids) for w, ids in held.items() if len(w) <= CACHED_LENGTH)
        return b"".join(found)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per Python worker, with what it has met in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def hashed(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of integer keys; different keys have different ones."""
    return common.mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(common.HASH_BASE))


def marks(hashes: np.ndarray) -> np.ndarray:
    """The stored fingerprint of each key."""
    return (common.mixed(hashes ^ np.uint64(common.HASH_INVERSE)) >> np.uint64(32)).astype("<u4")


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slots(hashes: np.ndarray, seeds, n: int) -> np.ndarray:
    """Where keys go by their bucket's seed; a negative seed names the slot itself."""
    seeds = np.atleast_1d(np.asarray(seeds, np.int64))
    spread = common.mixed(hashes ^ common.mixed(np.maximum(seeds, 0).astype(np.uint64) + np.uint64(1)))
    return np.where(seeds < 0, -1 - seeds, (spread % np.uint64(n)).astype(np.int64))


def perfect(hashes: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of distinct hashes: slots(h, seeds[buckets(h)], n) is a permutation of 0 to n - 1.

    Buckets of one size are tried together, a displacement a round; of those that meet in a slot one stays."""
    n = len(hashes)
    count = -(-n // BUCKET_KEYS)
    seeds = np.zeros(count, "<i4")
    if not n:
        return seeds
    of = buckets(hashes, count)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=count)
    firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    taken, claim = np.zeros(n, bool), np.zeros(n, np.int64)
    for size in range(int(sizes.max()), 1, -1):
        left = np.flatnonzero(sizes == size)
        keys = hashes[order[firsts[left][:, None] + np.arange(size)]]
        seed = 0
        while len(left):
            at = slots(keys, seed, n)
            apart = np.sort(at, 1)
            fit = ~taken[at].any(1) & (apart[:, 1:] != apart[:, :-1]).all(1)
            rows = np.flatnonzero(fit)
            claim[at[rows]] = rows[:, None]
            rows = rows[(claim[at[rows]] == rows[:, None]).all(1)]
            taken[at[rows]] = True
            seeds[left[rows]] = seed
            stay = np.ones(len(left), bool)
            stay[rows] = False
            left, keys, seed = left[stay], keys[stay], seed + 1
    seeds[sizes == 1] = -1 - np.flatnonzero(~taken)[: int((sizes == 1).sum())]
    return seeds


class ShardWriter:
    """One shard: payloads go to the file as they come, the index after them."""

    def __init__(self, files: pa.fs.FileSystem, folder: str, kind: str):
        self.name = f"{uuid.uuid4().hex}.ids"
        self.out = files.open_output_stream(f"{folder}/{self.name}")
        self.width = np.dtype(kind).itemsize
        self.places, self.keys, self.nulls = [0], [], 0

    def add(self, key: int | None, payload: bytes) -> None:
        self.out.write(payload)
        self.places.append(self.places[-1] + len(payload) // self.width)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def full(self) -> bool:
        return self.places[-1] * self.width >= SHARD_BYTES or len(self.places) > SHARD_DOCS

    def close(self) -> dict:
        keys, first, counts = np.unique(np.array(self.keys, np.int64), return_index=True, return_counts=True)
        hashes = hashed(keys)
        seeds = perfect(hashes)
        at = slots(hashes, seeds[buckets(hashes, len(seeds))], len(keys)) if len(keys) else np.empty(0, np.int64)
        table = np.empty((3, len(keys)), "<u4")
        table[:, at] = marks(hashes), first + self.nulls, counts
        self.out.write(np.array(self.places, "<u8").tobytes())
        self.out.write(seeds.tobytes())
        self.out.write(np.ascontiguousarray(table.T).tobytes())
        self.out.write(FOOTER.pack(len(self.places) - 1, len(keys), self.nulls, len(seeds), self.places[-1], self.width, MAGIC))
        self.out.close()
        return {"file": self.name, "least": int(keys[0]) if len(keys) else None, "most": int(keys[-1]) if len(keys) else None, "nulls": self.nulls, "docs": len(self.places) - 1, "ids": self.places[-1]}


class Shard:
    """A shard that is read: its parts are found from the footer, and read when they are asked for."""

    def __init__(self, files: pa.fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        end = self.file.size() - FOOTER.size
        self.docs, self.keys, self.nulls, self.buckets, self.ids, self.width, magic = FOOTER.unpack(self._read(end, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard of ids: {path}")
        self.kind = f"<u{self.width}"
        self.places_at = self.ids * self.width
        self.seeds_at = self.places_at + 8 * (self.docs + 1)
        self.marks_at = self.seeds_at + 4 * self.buckets

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def get(self, key: int | None) -> list[tuple[int, np.ndarray]]:
        """(place in the shard, ids) of each document with this key: a fixed number of small reads, then the payloads."""
        first, n = 0, self.nulls
        if key is not None:
            h = hashed(np.array([key]))
            if not self.keys:
                return []
            seed = np.frombuffer(self._read(self.seeds_at + 4 * int(buckets(h, self.buckets)[0]), 4), "<i4")
            mark, first, n = struct.unpack("<III", self._read(self.marks_at + 12 * int(slots(h, seed, self.keys)[0]), 12))
            if mark != int(marks(h)[0]):
                return []
        if not n:
            return []
        places = np.frombuffer(self._read(self.places_at + 8 * first, 8 * (n + 1)), "<u8").astype(np.int64)
        return [(a, np.frombuffer(self._read(a * self.width, (b - a) * self.width), self.kind)) for a, b in zip(places.tolist(), places[1:].tolist())]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of many keys at once; the index is read once and kept."""
        if not hasattr(self, "seeds"):
            self.seeds = np.frombuffer(self._read(self.seeds_at, 4 * self.buckets), "<i4")
            self.table = np.frombuffer(self._read(self.marks_at, 12 * self.keys), "<u4").reshape(-1, 3)
        if not self.keys:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h = hashed(keys)
        row = self.table[slots(h, self.seeds[buckets(h, self.buckets)], self.keys)]
        there = row[:, 0] == marks(h)
        return row[:, 1].astype(np.int64), np.where(there, row[:, 2], 0).astype(np.int64)

    def documents(self, first: int, n: int) -> Iterator[tuple[int, bytes]]:
        """(place, payload) of n documents in a row, read one by one."""
        for at in range(first, first + n, 1024):
            many = min(1024, first + n - at)
            places = np.frombuffer(self._read(self.places_at + 8 * at, 8 * (many + 1)), "<u8").astype(np.int64).tolist()
            for a, b in zip(places, places[1:]):
                yield a, self._read(a * self.width, (b - a) * self.width)


@dataclass(frozen=True)
class Store:
    """Shards in a folder. shards: (shard, file, least, most, nulls, docs, ids, start), in the order of keys."""

    folder: str
    shards: DataFrame


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2) -> Store:
    """Encodes all texts, ends each with end_id, and writes their shards below folder, which all executors see."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is no integer")
    common.small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("key"), common.clean_text(text_col).alias("text"))
    # equal keys may be many: the hash of the text, then chance, divide them
    dealt = rows.withColumns({"h": F.xxhash64("text"), "r": F.rand(7)}).repartitionByRange(F.col("key").asc_nulls_first(), "h", "r").sortWithinPartitions(F.col("key").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        encoder = _encoder(tokenizer)
        end = b"" if end_id is None else encoder.packed([end_id])
        part, made, writer = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer = writer or ShardWriter(files, path, encoder.kind)
                writer.add(key, encoder.text(text) + end)
                if writer.full():
                    made, writer = [*made, writer.close()], None
        if writer is not None:
            made.append(writer.close())
        if made:
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": i, **x} for i, x in enumerate(made)], schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("nulls", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    made = common.stored(dealt.select("key", "text").mapInArrow(common.frugal(run), "part long, seq long, file string, least long, most long, nulls long, docs long, ids long"))
    return Store(folder, _started(made))


def _started(made: DataFrame) -> DataFrame:
    """The manifest with each shard's number and the ids before it: sums within groups of 1,024 tasks, then over the groups."""
    group = F.floor(F.col("part") / 1024).alias("group")
    groups = made.groupBy(group).agg(F.sum("ids").alias("in_group"), F.count("*").alias("shards"))
    over = W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)  # one row for each 1,024 tasks
    groups = groups.select("group", F.coalesce(F.sum("in_group").over(over), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("shards").over(over), F.lit(0)).alias("shards_before"))
    within = W.partitionBy("group").orderBy("part", "seq")
    inner = made.withColumn("group", group).withColumns({"n": F.row_number().over(within) - 1, "upto": F.sum("ids").over(within)})
    joined = inner.join(groups, "group")
    return joined.select((F.col("shards_before") + F.col("n")).cast("long").alias("shard"), "file", "least", "most", "nulls", "docs", "ids", (F.col("ids_before") + F.col("upto") - F.col("ids")).cast("long").alias("start"))


def lookup(store: Store, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids binary of little-endian unsigned 32-bit integers) of each stored document that has one of the keys."""
    return _read(store, keys, id_col, "ids binary", lambda payloads: pa.array(payloads, pa.binary()))


def checksums(store: Store, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lookup() with the ids' unsigned CRC-32 in place of the ids."""
    return _read(store, keys, id_col, "ids_crc32 long", lambda payloads: pa.array([zlib.crc32(x) for x in payloads], pa.int64()))


def _read(store: Store, keys: DataFrame, id_col: str, column: str, of) -> DataFrame:
    spark = keys.sparkSession
    common.small_batches(spark)
    # key ranges of shards, in the order of keys: 24 bytes for each shard of 64 MB, which is checked
    many = store.shards.count()
    if many * 24 > RANGE_BYTES:
        raise ValueError(f"{many} shards: write larger ones")
    known = store.shards.orderBy("shard").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.select(["least", "most", "nulls"]).schema) as out:
        out.write_table(known.select(["least", "most", "nulls"]))
    sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, shard) of each shard whose range holds the key."""
        ranges = pa.ipc.open_stream(sent.value).read_all()
        least, most = (ranges.column(c) for c in ("least", "most"))
        real = np.flatnonzero(least.is_valid().to_numpy())
        least, most = (c.drop_null().to_numpy().astype(np.int64) for c in (least, most))
        with_nulls = np.flatnonzero(ranges.column("nulls").to_numpy() > 0)
        for batch in batches:
            column = batch.column(0)
            asked = column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first, end = np.searchsorted(most, asked, "left"), np.searchsorted(least, asked, "right")
            n = np.maximum(end - first, 0)
            which = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
            out = pa.array(np.repeat(asked, n)), pa.array(real[which].astype(np.int64))
            if column.null_count:
                out = pa.concat_arrays([out[0], pa.nulls(len(with_nulls), pa.int64())]), pa.concat_arrays([out[1], pa.array(with_nulls.astype(np.int64))])
            yield pa.RecordBatch.from_arrays(list(out), names=["key", "shard"])

    folder, out_names = store.folder, ["key", "start", "n_tokens", column.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pa.fs.FileSystem.from_uri(folder)
        held, shard = None, None
        for batch in batches:
            names, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
            column = batch.column("key")
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if names[a] != held:
                    held, shard = names[a], Shard(files, f"{path}/{names[a]}")
                part = column.slice(a, b - a)
                first, n = shard.find(part.fill_null(0).to_numpy(zero_copy_only=False))
                absent = part.is_null().to_numpy(zero_copy_only=False)
                first, n = np.where(absent, 0, first), np.where(absent, shard.nulls, n)
                made, size = ([], [], []), 0
                for key, f, m in zip(part.to_pylist(), first.tolist(), n.tolist()):
                    for at, payload in shard.documents(f, m):
                        ids = np.frombuffer(payload, shard.kind).astype("<u4").tobytes()
                        for x, y in zip(made, (key, starts[a] + at, ids)):
                            x.append(y)
                        size += len(ids)
                        if size > common.BATCH_BYTES:
                            yield _batch(made, of, out_names)
                            made, size = ([], [], []), 0
                if made[0]:
                    yield _batch(made, of, out_names)

    asked = keys.select(F.col(id_col).cast("long").alias("key")).distinct().mapInArrow(place, "key long, shard long")
    met = asked.join(store.shards.select("shard", "file", "start"), "shard").repartition(min(max(1, many), READERS), "shard").sortWithinPartitions("file", "key")
    return met.select("key", "file", "start").mapInArrow(common.frugal(run), f"key long, start long, n_tokens long, {column}")


def _batch(made: tuple[list, list, list], of, names: list[str]) -> pa.RecordBatch:
    keys, starts, payloads = made
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in payloads], pa.int64()), of(payloads)], names=names)


def report(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back by its key from the files that it was written to."""
    spark: SparkSession = docs.sparkSession
    folder = f"{common.shared_folder(spark)}/marlstone-{uuid.uuid4().hex}"
    atexit.register(common._dropped, spark, folder)
    found = checksums(write(docs, folder, tokenizer=tokenizer, end_id=end_id), docs.select("doc_id"))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
