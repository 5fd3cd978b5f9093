"""Versions of a stored table: which of its parts count. A change writes new parts first and then names them in a new version.

Versions are small JSON files, numbered, in a folder beside the parts; the highest counts. A change that fails before its
version is written leaves parts that nothing names and the old state. There is one writer at a time; one that finds the version that it
wants to write is told so. Readers keep the parts that their version names; `swept` deletes those that no version from a given
one on names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.of = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        folder = self.of(f"{self.path}/versions")
        names = [x.getPath().getName() for x in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        place = self.of(f"{self.path}/versions/{number}")
        found = self.files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8"))
        finally:
            found.close()

    def current(self) -> tuple[int, dict]:
        """(number, content) of the highest version; (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, after: int, content: dict) -> int:
        """Writes the version behind `after`."""
        number = after + 1
        target, draft = self.of(f"{self.path}/versions/{number}"), self.of(f"{self.path}/versions/draft-{uuid.uuid4().hex}")
        out = self.files.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.files.exists(target) or not self.files.rename(draft, target):
            self.files.delete(draft, False)
            raise RuntimeError(f"another writer has made version {number} of {self.path}")
        return number

    def part(self) -> str:
        """The name of a new part."""
        return uuid.uuid4().hex

    def swept(self, folder: str, named: Iterable[str]) -> int:
        """Deletes what stands in a folder and isn't named; the number of parts deleted."""
        place, keep, gone = self.of(f"{self.path}/{folder}"), set(named), 0
        for x in self.files.listStatus(place) if self.files.exists(place) else []:
            if x.getPath().getName() not in keep:
                self.files.delete(x.getPath(), True)
                gone += 1
        return gone
