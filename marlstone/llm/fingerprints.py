"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of the hash range.

Shingles are runs of SHINGLE code points, their hashes have 48 bits. The fraction is the same for all documents; a text with
fewer than FLOOR hashes below it keeps its FLOOR least ones, a shorter one all. So a sketch has a threshold of its own, below
which it is complete and which can be read off it. Sketches of parts merge by union. Two sketches are compared below the
lesser of their thresholds, where the share of common hashes estimates containment and likeness, also between texts of very
unequal length. A sketch is written as the number of its hashes and the hashes in order, in base 64.

Documents are dealt out once, by ranges of ids; a range gets an extra copy of the row that follows it.

Nulls: a null text counts as empty; its sketch is empty, and two empty sketches are alike (1.0). A text shorter than a
shingle is one shingle. A null id sorts first and stays null. Rows of one id are in the order of their texts, equal ones are
alike; they are one range, read in order by one task. A table of one row is followed by itself; an empty one gives an empty
result. Very long texts are hashed in one numpy pass each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import common

SHINGLE = 12
FRACTION = 16  # one hash in so many is kept
FLOOR = 64  # hashes that are kept in any case
LIMIT = 2**48 // FRACTION
#: Rows of a range of ids, about, as long as that makes no more than RANGES of them; a range is read in order, not held.
RANGE_ROWS, RANGES = 4000, 65_536
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of `size` code points; of the whole text if it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.empty(0, np.uint64)
    size = min(size, len(points))
    with np.errstate(over="ignore"):
        letters = (points.astype(np.uint64) + np.uint64(1)) * BASE
        letters ^= letters >> np.uint64(29)
        n = len(letters) - size + 1
        # runs double in length: a run of 2k is two of k, and size is put together from these
        whole, done, run, length = np.zeros(n, np.uint64), 0, letters, 1
        while True:
            if size & length:
                whole = whole * BASE + run[done : done + n]
                done += length
            if length * 2 > size:
                break
            run = run[:-length] * (BASE + np.uint64(2 * length)) + run[length:]
            length *= 2
        return mixed(whole) >> np.uint64(16)


def least(hashes: np.ndarray) -> np.ndarray:
    """Those of a set of hashes that a sketch keeps, in order."""
    kept = np.unique(hashes[hashes < LIMIT])
    return kept if len(kept) >= FLOOR else np.unique(hashes)[:FLOOR]


def sketch(text: str) -> np.ndarray:
    """The sorted hashes that are kept of a text."""
    return least(shingle_hashes(text))


def threshold(kept: np.ndarray) -> int:
    """Below this a sketch has all hashes of its text."""
    return 2**48 if len(kept) < FLOOR else max(LIMIT, int(kept[-1]) + 1)


def written(kept: np.ndarray) -> str:
    return f"{len(kept)}:{base64.b64encode(kept.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()}"


def read(fingerprint: str) -> np.ndarray:
    parts = np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, 6)
    return np.pad(parts, ((0, 0), (2, 0))).view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of all shingles of both texts."""
    return least(np.union1d(a, b))


def common_range(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What both sketches have below the lesser threshold."""
    most = min(threshold(a), threshold(b))
    return a[: np.searchsorted(a, most)], b[: np.searchsorted(b, most)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of either text that are in both."""
    x, y = common_range(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of the first text that are in the second; 1 for an empty first text."""
    x, y = common_range(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else float(not len(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of each row."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), common.clean_text(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(sketch(t)) for t in batch.column(1).to_pylist()])], names=[id_col, "fingerprint"])

    return rows.mapInArrow(common.frugal(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fingerprint string")


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __range, __extra): the rows dealt by ranges of ids, and at each range's end an extra copy of the row that follows it.

    Texts are shuffled once. Bounds of ranges and the ids that begin them are tables of RANGES rows at most."""
    none = -(2**63)
    rows = docs.select("doc_id", common.clean_text().alias("text"))
    ids = rows.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)).alias("__id"))
    ranges = max(1, min(ids.count() // RANGE_ROWS, RANGES))
    cuts = sorted(set(ids.approxQuantile("__id", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    splits = [float("-inf"), *cuts, float("inf")]
    placed = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))
    if cuts:
        placed = Bucketizer(splits=splits, inputCol="__id", outputCol="__at").transform(placed)
    else:
        placed = placed.withColumn("__at", F.lit(0.0))
    placed = placed.select("doc_id", "text", F.col("__at").cast("int").alias("__range"), F.coalesce("doc_id", F.lit(none)).alias("__key"))
    firsts = placed.groupBy("__range").agg(F.min("__key").alias("__key"))
    order = W.orderBy("__range")  # of RANGES rows at most
    firsts = firsts.select("__key", F.coalesce(F.lag("__range").over(order), F.max("__range").over(W.partitionBy())).alias("__before"))
    heads = placed.drop("__range").join(F.broadcast(common.checkpointed(firsts)), "__key")  # RANGES bounds what is broadcast
    heads = heads.groupBy("__key").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("__before").alias("__range"))
    both = placed.select("doc_id", "text", "__range", F.lit(False).alias("__extra")).unionByName(heads.select("doc_id", "text", "__range", F.lit(True).alias("__extra")))
    return both.repartition(max(2, len(splits) - 1), "__range").sortWithinPartitions("__range", "__extra", F.asc_nulls_first("doc_id"), "text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text: the last half of the code points replaced by as many, or all, of the first ones of the next document."""
    common.small_batches(docs.sparkSession)
    rows = followed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def result(doc: str, own: np.ndarray, after: str, after_sketch: np.ndarray) -> tuple:
        half = len(doc) // 2
        edited = doc[: len(doc) - half] + after[:half]
        changed = sketch(edited)
        return len(doc), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, after_sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row read, its range and sketch
        for batch in batches:
            ids, out = [], []
            for doc_id, text, place, extra in zip(*(c.to_pylist() for c in batch.columns)):
                own = sketch(text)
                if held is not None and held[2] == place and not held[4]:
                    ids.append(held[0])
                    out.append(result(held[1], held[3], text, own))
                held = (doc_id, text, place, own, extra)
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(common.frugal(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
