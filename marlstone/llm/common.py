"""Shared pieces of the training-data operators: tables, checkpoints, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: rows are whole texts, and a batch is held by the JVM and a Python worker, here also as str.
BATCH_ROWS, BATCH_BYTES = 400, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and by bytes; smaller bounds of the caller stay.

    Spark reads these two settings when a plan is made, which is after an operator has returned it, so they hold from then on."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
        held = int(number) << 10 * " kmgtp".index(unit or " ")
        if held <= 0 or held > most:
            spark.conf.set(key, most)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives its free memory back: workers are kept for later tasks beside the JVM."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return mapped


def clean_text(column: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, kept in the shared checkpoint folder, so that lost executors cost no recomputation of what comes before."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a temporary local one where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "marlstone-checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table to the shared folder and read again; for tables that a checkpoint would keep uncompressed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_dropped, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(df: DataFrame) -> None:
    """Deletes the files of a table that stored() gave and that nothing will read any more."""
    _dropped(df.sparkSession, df._stored_at)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of finished jobs now: it does so when the driver collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


def _dropped(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended before
        pass


def text_chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts with about `most` characters; a longer text has a run of its own."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)


def packed(rows: Iterable[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())


def joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


#: An odd base of polynomial hashes modulo 2**64, and its inverse.
HASH_BASE = 0x9E3779B97F4A7C15
HASH_INVERSE = pow(HASH_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((HASH_BASE, HASH_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


class RunHashes:
    """Hashes of all runs of a sequence of values, each from two prefix sums; equal runs have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray):
        self.power, inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * inverse[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.power[starts])

    def fixed(self, length: int) -> np.ndarray:
        """Of each run of this length."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.power[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (a, b): the root is the least node that is connected with it.

    Alternating large and small stars; each round is kept in the checkpoint folder, and nothing but counts reaches the driver."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
