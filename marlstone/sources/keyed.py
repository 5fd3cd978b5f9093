"""A stored table with unique keys that is changed in place: a merge writes the files of the keys that it touches, and no others.

Rows lie in files by ranges of their key; where ranges begin is part of the version, as is the file of each range. A merge
reads the ranges that its rows fall into, writes them anew beside the old ones, and then commits a version that names them. What
fails before leaves the old state, and readers of an older version keep their files until they are swept.

Keys are the values of one or more columns; a null is a value of its own. Of rows with one key the last by the order column stays,
ties and rows without order go by the other columns. An empty merge changes nothing. Imports of neighbouring keys touch few
ranges; keys from all over the table touch as many ranges as they fall into."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.lineage import kept
from marlstone.functions.versions import Versions

#: Rows of a range when the table is made, about, and ranges at most: their beginnings go to all tasks.
FILE_ROWS, RANGES = 100_000, 50_000


class KeyedTable:
    """The table in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("id",)):
        self.spark, self.path, self.keys = spark, path, keys
        self.versions = Versions(spark, path)

    def key(self) -> Column:
        """The key as one text; nulls, and values that hold the separator, are told apart."""
        parts = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(k).cast("string"), "[\x01\x02]", "\x02$0")), F.lit("")) for k in self.keys]
        return F.concat_ws("\x01", *parts)

    def create(self, rows: DataFrame, order: str | None = None, file_rows: int = FILE_ROWS) -> None:
        """Replaces what there is by these rows, in ranges of about file_rows."""
        number = self.versions.current()[0]
        single = kept(self._last(rows, order))
        ranges = max(1, min(single.count() // file_rows, RANGES))
        begins = [""]
        if ranges > 1:
            dealt = single.select("__key").repartitionByRange(ranges, "__key")
            begins += [r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("__key").alias("k")).select("k").orderBy("k").collect()][1:]  # a key a range
        files = self._written(single, begins)
        self.versions.commit(number, {"begins": begins, "files": files, "schema": single.drop("__key").schema.jsonValue()})

    def merge(self, rows: DataFrame, order: str | None = None) -> list[int]:
        """Puts rows in place of those with their keys and adds the others; the ranges that were written."""
        return self._merged(self._last(rows, order))

    def insert(self, rows: DataFrame) -> list[int]:
        """Adds rows whose keys aren't there and don't repeat; else nothing changes and ValueError names one."""
        keyed = kept(rows.withColumn("__key", self.key()))
        twice = keyed.groupBy("__key").count().where("count > 1").select("__key")
        ranges = sorted(r[0] for r in _ranged(keyed.select("__key"), self.versions.current()[1]["begins"]).select("__range").distinct().collect())
        there = self._rows(ranges).join(keyed, "__key", "left_semi").select("__key") if ranges else twice
        found = twice.union(there).limit(1).collect()
        if found:
            raise ValueError(f"the key is there already: {found[0][0]!r}")
        return self._merged(keyed)

    def delete(self, keys: DataFrame) -> list[int]:
        """Takes the rows with these keys out; the ranges that were written."""
        return self._merged(keys.select(self.key().alias("__key")).distinct(), stay=False)

    def read(self) -> DataFrame:
        return self._rows().drop("__key")

    def sweep(self) -> int:
        """Deletes files that the current version doesn't name; nobody may be reading an older one."""
        files = self.versions.current()[1].get("files", {})
        gone = self.versions.swept("parts", set(files.values()))
        for part in set(files.values()):
            gone += self.versions.swept(f"parts/{part}", [f"range={r}" for r, p in files.items() if p == part] + ["_SUCCESS"])
        return gone

    def _last(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row a key, with the key; counted before keys meet."""
        columns = [c for c in rows.columns if c != order]
        found = rows.withColumn("__key", self.key()).groupBy("__key").agg(F.max(F.struct(*([order] if order else []), *columns)).alias("r"))
        return found.select("__key", *[F.col(f"r.{c}").alias(c) for c in rows.columns])

    def _rows(self, ranges: list[int] | None = None) -> DataFrame:
        """The rows of all ranges or of some, whose files alone are read, with their keys."""
        now = self.versions.current()[1]
        schema = T.StructType.fromJson(now["schema"])
        chosen = [f"{self.path}/parts/{p}/range={r}" for r, p in now["files"].items() if ranges is None or int(r) in ranges]
        found = self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)
        return found.withColumn("__key", self.key())

    def _merged(self, rows: DataFrame, stay: bool = True) -> list[int]:
        number, now = self.versions.current()
        coming = kept(_ranged(rows, now["begins"]))
        touched = sorted(r[0] for r in coming.select("__range").distinct().collect())  # ranges
        if not touched:
            return []
        others = self._rows(touched).join(coming.select("__key"), "__key", "left_anti")
        made = others.unionByName(coming.select(*others.columns)) if stay else others
        files = {r: p for r, p in now["files"].items() if int(r) not in touched} | self._written(made, now["begins"])
        self.versions.commit(number, {**now, "files": files})
        return touched

    def _written(self, rows: DataFrame, begins: list[str]) -> dict[str, str]:
        """Writes rows by range; the part of each range that has rows."""
        part = self.versions.part()
        ranged = _ranged(rows, begins).withColumnRenamed("__range", "range")
        ranged.repartition(min(len(begins), 2000), "range").sortWithinPartitions("range", "__key").drop("__key").write.partitionBy("range").parquet(f"{self.path}/parts/{part}")
        names = [x.getPath().getName() for x in self.versions.files.listStatus(self.versions.of(f"{self.path}/parts/{part}"))]
        return {n.removeprefix("range="): part for n in names if n.startswith("range=")}


def _ranged(rows: DataFrame, begins: list[str]) -> DataFrame:
    """rows with the number of the range that holds their __key; begins are RANGES texts at most."""
    at, sent = rows.columns.index("__key"), rows.sparkSession.sparkContext.broadcast(np.array([b.encode() for b in begins], object))

    def run(batches):
        for batch in batches:
            keys = np.array([k.encode() for k in batch.column(at).to_pylist()], object)
            place = np.searchsorted(sent.value, keys, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int32))], names=[*batch.schema.names, "__range"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType())]))
