"""Cutting lineage in loops, and scratch folders that all executors see."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.functions.session import plain_unions


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary local one only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "marlstone-checkpoints")


def kept(df: DataFrame) -> DataFrame:
    """df in the session's shared checkpoint folder."""
    plain_unions(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


#: Folders of written tables, which go when Python ends.
_folders: dict[str, tuple] = {}


def _emptied() -> None:
    for place, conf in _folders.values():
        try:
            place.getFileSystem(conf).delete(place, True)
        except Exception:  # the session's process has ended before  # noqa: BLE001
            pass


atexit.register(_emptied)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for loops of many rounds.

    A checkpoint keeps the plan's estimate of its size, and joins multiply estimates, so that in a loop the number of digits doubles each
    round; the size of a table is that of its files."""
    spark = df.sparkSession
    plain_unions(spark)
    app = spark.sparkContext.applicationId
    root = f"{shared_folder(spark)}/marlstone-written-{app}"
    if app not in _folders:
        _folders[app] = (spark._jvm.org.apache.hadoop.fs.Path(root), spark.sparkContext._jsc.hadoopConfiguration())
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class scratch:
    """A folder below the shared one, deleted at the end; what is read from it is held by a checkpoint before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/marlstone-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *_) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    held = staticmethod(kept)
