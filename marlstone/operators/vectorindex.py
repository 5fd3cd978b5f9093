"""A stored vector index: cells as partitions, product codes after a learned rotation, inserts, re-split cells, keyed by versions.

Centres come from k-means, the rotation and the code books from a bounded sample. Vectors are stored with their codes by cell, so
that a search opens the files of the cells that it probes and no others: candidates are found by the codes alone, then
ranked by whole vectors. Inserts use what was fitted before; a cell that has grown beyond a bound is split into cells of its
own, and only its vectors are written again. How many cells a search probes can be measured against exact search for a recall.

Vectors are unit vectors of one length, or else scores are their inner products; null ones are left out. Ids are distinct. An empty
insert adds a part without rows. The index can't be built without vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone import config
from marlstone.functions.lineage import kept
from marlstone.functions.versions import Versions
from marlstone.operators import dense

#: Vectors that rotation and books, or a split cell's centres, are fitted on at most; rounds of the rotation.
SAMPLE, SPLIT_SAMPLE, TURNS = 20_000, 20_000, 6
#: Vectors whose neighbours are looked up exactly to measure recall.
MEASURED = 256


class VectorIndex:
    """The index in a folder that all executors see; vectors are (doc_id, vector)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, path)

    # parts of a version

    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/models/{self.versions.current()[1]['centres']}")

    def _codes(self) -> tuple[np.ndarray, np.ndarray]:
        row = self.spark.read.parquet(f"{self.path}/models/{self.versions.current()[1]['codes']}").first()
        return np.frombuffer(row["books"], "<f8").reshape(row["shape"]), np.frombuffer(row["rotation"], "<f8").reshape(row["shape"][0] * row["shape"][2], -1)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(doc_id, vector, code, cell) of all cells or of some, whose files alone are read."""
        out = None
        now = self.versions.current()[1]
        for part in now["parts"]:
            found = self.spark.read.schema(T.StructType.fromJson(now["schema"])).parquet(f"{self.path}/parts/{part['name']}")
            if part["without"]:
                found = found.where(~F.col("cell").isin(part["without"]))
            if cells is not None:
                found = found.where(F.col("cell").isin(cells))
            out = found if out is None else out.unionByName(found)
        return out

    def _write(self, df: DataFrame, folder: str, by: str | None = None) -> str:
        name = self.versions.part()
        if by:  # a cell is a file or, if it is large, several
            df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(f"{self.path}/{folder}/{name}")
        else:
            df.coalesce(1).write.parquet(f"{self.path}/{folder}/{name}")
        return name

    # changes

    def build(self, vectors: DataFrame, nlist: int = 100, m: int = 8, bits: int = 8, seed: int = 42) -> None:
        """Writes a new index over the vectors."""
        number = self.versions.current()[0]
        cells, centres = dense.build_cells(vectors.where(F.col("vector").isNotNull()).select("doc_id", "vector"), nlist, seed)
        cells = cells.select("doc_id", F.col("vector").cast("array<double>").alias("vector"), F.col("cell").cast("int").alias("cell"))
        joined = cells.join(F.broadcast(centres), "cell")  # nlist centres
        books, rotation = dense.fit_codes(dense.picked(joined, SAMPLE, seed), m, bits, seed, TURNS)
        held = self.spark.createDataFrame([(books.astype("<f8").tobytes(), rotation.astype("<f8").tobytes(), list(books.shape))], "books binary, rotation binary, shape array<int>")
        content = {"centres": self._write(centres, "models"), "codes": self._write(held, "models"), "next": nlist, "parts": []}
        made = dense.code(joined, books, rotation)
        content["schema"] = made.schema.jsonValue()
        content["parts"].append({"name": self._write(made, "parts", "cell"), "without": []})
        self.versions.commit(number, content)

    def insert(self, vectors: DataFrame) -> None:
        """Adds vectors to the cells that there are; nothing is fitted again."""
        number, content = self.versions.current()
        placed = assigned(vectors.where(F.col("vector").isNotNull()).select("doc_id", F.col("vector").cast("array<double>").alias("vector")), self.centres())
        name = self._write(dense.code(placed, *self._codes()), "parts", "cell")
        self.versions.commit(number, {**content, "parts": [*content["parts"], {"name": name, "without": []}]})

    def split(self, most: int, seed: int = 42) -> list[int]:
        """Splits the cells of more than `most` vectors and writes these, and no others, again; the cells that were split."""
        number, content = self.versions.current()
        sizes = {r["cell"]: r["count"] for r in self.rows().groupBy("cell").count().where(F.col("count") > most).collect()}  # cells at most
        if not sizes:
            return []
        fat = self.rows(sorted(sizes)).select("doc_id", "vector", "cell")
        wanted = self.spark.createDataFrame([(c, -(-n // most), min(1.0, SPLIT_SAMPLE / n)) for c, n in sorted(sizes.items())], "cell int, parts int, share double")
        some = fat.join(F.broadcast(wanted), "cell").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

        def fit(part: pa.Table) -> pa.Table:
            x, n = dense.matrix(part, "vector"), part.column("parts")[0].as_py()
            x = x[np.lexsort(x.T)]
            book = dense.lloyd(x, x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)].copy(), 10)
            return pa.table({"old": pa.array([part.column("cell")[0].as_py()] * len(book), pa.int32()), "centre": pa.array(book.tolist(), pa.list_(pa.float64()))})

        made = some.select("cell", "parts", "vector").groupBy("cell").applyInArrow(fit, "old int, centre array<double>").collect()  # cells
        made = sorted((r["old"], r["centre"]) for r in made)
        fresh = self.spark.createDataFrame([(content["next"] + i, old, centre) for i, (old, centre) in enumerate(made)], "cell int, old int, centre array<double>")
        placed = assigned(fat.withColumnRenamed("cell", "old"), fresh, "old")
        name = self._write(dense.code(placed, *self._codes()), "parts", "cell")
        centres = self.centres().where(~F.col("cell").isin(sorted(sizes))).unionByName(fresh.select("cell", "centre"))
        parts = [{"name": p["name"], "without": sorted({*p["without"], *sizes})} for p in content["parts"]] + [{"name": name, "without": []}]
        self.versions.commit(number, {**content, "centres": self._write(centres, "models"), "next": content["next"] + len(made), "parts": parts})
        return sorted(sizes)

    def sweep(self) -> int:
        """Deletes what the current version doesn't name, also the cells of a part that were split; nobody may be reading an older version."""
        content = self.versions.current()[1]
        gone = self.versions.swept("parts", [p["name"] for p in content["parts"]]) + self.versions.swept("models", [content["centres"], content["codes"]])
        for part in content["parts"]:
            place = self.versions.of(f"{self.path}/parts/{part['name']}")
            names = [x.getPath().getName() for x in self.versions.files.listStatus(place)]
            gone += self.versions.swept(f"parts/{part['name']}", [n for n in names if n not in {f"cell={c}" for c in part["without"]}])
        return gone

    # search

    def calibrate(self, recall: float, k: int = config.TOP_K, seed: int = 42) -> int:
        """Finds, and keeps, how many cells hold that share of the exact neighbours of at most about MEASURED vectors, which are left out themselves."""
        number, content = self.versions.current()
        rows = self.rows().select("doc_id", "vector", "cell")
        asked = kept(dense.picked(rows, MEASURED, seed).select(F.col("doc_id").alias("qid"), "vector"))
        found = dense.exact(rows.select("doc_id", "vector"), asked, k, itself=False).select("qid", "doc_id")
        cells = self.centres()
        ranks = dense.nearest_cells(cells, asked, cells.count()).select("qid", "cell", "probe")
        at = found.join(rows.select("doc_id", "cell"), "doc_id").join(ranks, ["qid", "cell"])
        nprobe = int(at.agg(F.percentile("probe", F.lit(recall))).first()[0] or 1) + 1
        self.versions.commit(number, {**content, "nprobe": nprobe})
        return nprobe

    def search(self, queries: DataFrame, k: int = config.TOP_K, nprobe: int | None = None, refine: int = 10) -> DataFrame:
        """(qid, doc_id, score, rank) of the k nearest among the vectors of each query's nprobe cells; nprobe: what calibrate() found, else 10."""
        nprobe = nprobe or self.versions.current()[1].get("nprobe", 10)
        books, rotation = self._codes()
        return dense.probe_codes(self._probed(queries, nprobe), self.centres(), books, queries, k, nprobe, refine, rotation)

    def _probed(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """The rows of the cells that any of the queries probes."""
        near = dense.nearest_cells(self.centres(), queries.select("qid", "vector"), nprobe)
        return self.rows(sorted(r[0] for r in near.select("cell").distinct().collect()))  # cells


def assigned(vectors: DataFrame, centres: DataFrame, within: str | None = None) -> DataFrame:
    """vectors with the cell and the centre nearest to them, of those that agree in the column `within`; centres are as many as cells."""
    known = centres.orderBy("cell").collect()
    numbers = np.array([r["cell"] for r in known], np.int32)
    points = np.array([r["centre"] for r in known], float)
    groups = np.array([r[within] for r in known], np.int64) if within else None
    sent = vectors.sparkSession.sparkContext.broadcast((numbers, points, groups))

    def run(batches):
        numbers, points, groups = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense.matrix(pa.Table.from_batches([batch]), "vector")
            if groups is None:
                near = dense.nearest_rows(x, points)
            else:
                of, near = batch.column(within).to_numpy(zero_copy_only=False), np.zeros(len(x), np.int64)
                for g in np.unique(of):
                    rows, own = np.flatnonzero(of == g), np.flatnonzero(groups == g)
                    near[rows] = own[dense.nearest_rows(x[rows], points[own])]
            out = [batch.column("doc_id"), batch.column("vector"), pa.array(numbers[near]), pa.array(points[near].tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "vector", "cell", "centre"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(run, f"doc_id {kinds['doc_id']}, vector {kinds['vector']}, cell int, centre array<double>")
