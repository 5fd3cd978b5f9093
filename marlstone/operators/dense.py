"""Vector search by inner product: exact in blocks, by cells, and with a hashing encoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import top, words

#: Rows of a candidate and of a query block; a task multiplies one of each.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Coded vectors of a cell that one task meets.
PART_ROWS = 65_536
#: Bytes of queries that are sent to all tasks, and results that a task may hold for them.
SHIPPED, HELD = 32 << 20, 2 << 20
#: Products that a task holds at once.
SCORES = 1 << 20
#: Texts whose counts a task holds at once.
HASHED_ROWS = 1024
#: Query rows whose distances are computed at once, and pairs whose differences are.
L2_ROWS, L2_PAIRS = 256, 65536


def one_array(table: pa.Table, column: str) -> pa.Array:
    """A column as one array."""
    out = table.column(column).combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def matrix(table: pa.Table, column: str) -> np.ndarray:
    return one_array(table, column).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64, copy=False)


def places(ids: pa.Array) -> np.ndarray | None:
    """The place of each id in their order, nulls first; None for a type that Arrow can't sort."""
    try:
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
    except pa.ArrowNotImplementedError:
        return None
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


def first(rows: np.ndarray, score: np.ndarray, place: np.ndarray | None, k: int) -> np.ndarray:
    """Positions of the k best of each row, by row and score, ties by place; without places also what ties with the k-th."""
    order = np.lexsort((-score, rows) if place is None else (place, -score, rows))
    sorted_rows = rows[order]
    start = np.searchsorted(sorted_rows, sorted_rows, "left")
    if place is not None:
        return order[np.arange(len(order)) - start < k]
    last = np.minimum(start + k, np.searchsorted(sorted_rows, sorted_rows, "right")) - 1
    return order[score[order] >= score[order][last]]


class Best:
    """The k best (id, score) of each of n rows, as a task meets them; floor is the k-th best score of a row so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor, self.waiting, self.held = n, k, np.full(n, -np.inf), [], 0

    def add(self, rows: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.waiting.append((rows, score, ids))
        if sum(len(p[0]) for p in self.waiting) >= 2 * self.held:  # floors are renewed when as many results wait as are held
            self.merge()

    def merge(self) -> None:
        rows, score = (np.concatenate([p[i] for p in self.waiting]) for i in (0, 1))
        ids = pa.concat_arrays([p[2] for p in self.waiting])
        keep = first(rows, score, places(ids), self.k)
        rows, score = rows[keep], score[keep]
        full = np.flatnonzero(np.bincount(rows, minlength=self.n) >= self.k)
        self.floor[full] = score[np.searchsorted(rows, full, "right") - 1]
        self.waiting, self.held = [(rows, score, ids.take(pa.array(keep)))], len(rows)

    def batches(self, names: pa.Array):
        """(qid, doc_id, score) with the rows' names."""
        if self.waiting:
            self.merge()
            rows, score, ids = self.waiting[0]
            for at in range(0, len(rows), L2_PAIRS):
                part = slice(at, at + L2_PAIRS)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[part])), ids[part], pa.array(score[part])], names=["qid", "doc_id", "score"])


def own_pairs(names: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of equal names and ids, by row."""
    at: dict = {}
    for i, x in enumerate(names.to_pylist()):
        at.setdefault(x, []).append(i)
    pairs = sorted((i, j) for j, x in enumerate(ids.to_pylist()) for i in at.get(x, ()))
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def own_part(own: tuple[np.ndarray, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    at = slice(*np.searchsorted(own[0], [low, high]))
    return own[0][at] - low, own[1][at]


def nearest(x: np.ndarray, y: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score): for each row of x the k nearest rows of y, ties by place; scores are negative distances to 9 digits.

    |x|^2+|y|^2-2xy with a bound of its rounding error only chooses candidates; distances come from differences."""
    n = min(k, len(y))
    norms, unit = (y**2).sum(1), 4 * (x.shape[1] + 8) * np.finfo(float).eps
    made = []
    for low in range(0, len(x), L2_ROWS):
        part = x[low : low + L2_ROWS]
        sums = (part**2).sum(1)[:, None] + norms[None, :]
        squares = sums - 2 * part @ y.T
        sums *= unit  # now the error bound
        upper, squares = squares + sums, squares - sums
        if own is not None:
            pairs = own_part(own, low, low + len(part))
            upper[pairs] = squares[pairs] = np.inf
        cut = np.sqrt(np.maximum(np.partition(upper, n - 1, axis=1)[:, n - 1], 0)) + 2e-9  # what rounds alike stays
        rows, columns = np.nonzero((squares <= (cut**2)[:, None]) & np.isfinite(squares))
        score = np.empty(len(rows))
        for i in range(0, len(rows), L2_PAIRS):
            at = slice(i, i + L2_PAIRS)
            score[at] = -np.round(np.sqrt(((part[rows[at]] - y[columns[at]]) ** 2).sum(1)), 9)
        kept = first(rows, score, None if place is None else place[columns], n)
        made.append((rows[kept] + low, columns[kept], score[kept]))
    return tuple(np.concatenate(z) for z in zip(*made))


def scored(x: np.ndarray, y: np.ndarray, k: int, metric: str, own: tuple[np.ndarray, np.ndarray] | None, place: np.ndarray | None = None, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score): for each row of x the k best rows of y, ties by place, in runs of at most about SCORES products.

    What is below a row's floor may be left out; own pairs are. Without places what ties with the k-th comes too."""
    if metric == "cosine":
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    if metric == "l2":
        return nearest(x, y, k, own, place)
    n, step, made = min(k, len(y)), max(1, SCORES // len(y)), []
    for low in range(0, len(x), step):
        score = x[low : low + step] @ y.T
        np.round(score, 9, out=score)
        if own is not None:
            score[own_part(own, low, low + len(score))] = -np.inf
        cut = np.full(len(score), -np.inf) if floor is None else floor[low : low + step]
        if np.isneginf(cut).any():
            cut = np.maximum(cut, np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n])
        rows, columns = np.nonzero((score >= cut[:, None]) & np.isfinite(score))
        found = score[rows, columns]
        kept = first(rows, found, None if place is None else place[columns], n)
        made.append((rows[kept] + low, columns[kept], found[kept]))
    return tuple(np.concatenate(z) for z in zip(*made))


def exact(vectors: DataFrame, queries: DataFrame, k: int = config.TOP_K, itself: bool = True, metric: str = "dot") -> DataFrame:
    """(qid, doc_id, score, rank): queries (qid, vector) against all vectors (doc_id, vector).

    Queries of up to SHIPPED bytes with up to HELD results, which is measured, are sent to where the vectors are; each task keeps the
    k best for each of them, so that vectors aren't shuffled. More queries and the vectors are dealt out in blocks, of which each pair meets in
    one task. Cosine is the inner product for unit vectors; "l2" gives distances, the smaller the better."""
    if metric not in ("dot", "cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    asked = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("numbers")).first()
    met = _shipped if asked["numbers"] * 8 <= SHIPPED and asked["n"] * k <= HELD else _in_blocks
    out = top(met(vectors, queries, asked["n"], k, itself, metric), ["qid"], [F.desc("score"), F.col("doc_id")], k)
    return out.withColumn("score", -F.col("score")) if metric == "l2" else out


def _shipped(vectors: DataFrame, queries: DataFrame, n: int, k: int, itself: bool, metric: str) -> DataFrame:
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()
    small = queries.select("qid", "vector").toArrow().combine_chunks()  # SHIPPED bounds it
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, small.schema) as writer:
        writer.write_table(small)
    sent = vectors.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches):
        held = pa.ipc.open_stream(sent.value).read_all()
        if not held.num_rows:
            return
        x, names = matrix(held, "vector"), one_array(held, "qid")
        best = Best(len(x), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            ids = one_array(part, "doc_id")
            rows, columns, score = scored(x, matrix(part, "vector"), k, metric, None if itself else own_pairs(names, ids), places(ids), best.floor)
            best.add(rows, score, ids.take(pa.array(columns)))
        yield from best.batches(names)

    return vectors.select("doc_id", "vector").mapInArrow(run, f"qid {kinds[0]}, doc_id {kinds[1]}, score double")


def _in_blocks(vectors: DataFrame, queries: DataFrame, n: int, k: int, itself: bool, metric: str) -> DataFrame:
    blocks = max(1, -(-vectors.count() // BLOCK))
    query_blocks = max(1, -(-n // QUERY_BLOCK))
    dealt = lambda n, key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = queries.select("qid", "vector", dealt(query_blocks, "qid").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = vectors.select("doc_id", "vector", dealt(blocks, "doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    kinds = queries.schema["qid"].dataType, vectors.schema["doc_id"].dataType

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": a.column("qid").slice(0, 0), "doc_id": b.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})
        ids = one_array(b, "doc_id")
        rows, columns, score = scored(matrix(a, "vector"), matrix(b, "vector"), k, metric, None if itself else own_pairs(one_array(a, "qid"), ids), places(ids))
        return pa.table({"qid": a.column("qid").take(pa.array(rows)), "doc_id": b.column("doc_id").take(pa.array(columns)), "score": pa.array(score)})

    schema = f"qid {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
    return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(meet, schema)


def hashed(docs: DataFrame, key: str, text: str, buckets: int = config.HASH_BUCKETS) -> DataFrame:
    """(key, vector): word counts by hash bucket, of unit length; words of under two characters don't count.

    Buckets are counted in the row itself, so encoding a corpus shuffles nothing."""
    bucket = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    used = F.transform(F.filter(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.length(w) > 1), bucket)

    def run(batches):
        for batch in (b.slice(at, HASHED_ROWS) for b in batches for at in range(0, b.num_rows, HASHED_ROWS)):
            lists = batch.column(1)
            counts = np.zeros((batch.num_rows, buckets))
            sizes = np.diff(lists.offsets.to_numpy())  # flatten() minds the slice
            np.add.at(counts, (np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy()), 1.0)
            counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1.0)
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, buckets), pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[key, "vector"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, used.alias("u")).mapInArrow(run, f"{key} {kind}, vector array<double>")


def build_cells(vectors: DataFrame, nlist: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(doc_id, vector, cell) and the cells' centres (cell, centre): coarse cells by k-means, to be stored with cell as the partition column."""
    ready = vectors.withColumn("features", array_to_vector("vector"))
    model = KMeans(k=nlist, seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(ready)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    return model.transform(ready).select("doc_id", "vector", "cell"), centres


def nearest_cells(centres: DataFrame, queries: DataFrame, nprobe: int) -> DataFrame:
    """queries with the cell, near and probe of their nprobe nearest cells; the number of cells is a parameter, so centres are broadcast."""
    from marlstone.functions.columns import dot

    near = queries.join(F.broadcast(centres)).withColumn("near", dot(F.col("vector"), F.col("centre")))
    return top(near, ["qid"], [F.desc("near"), F.col("cell")], nprobe, "probe")


def spread(near: DataFrame, cells: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (cell, part, block): a cell's vectors in parts of about `rows`, its queries in blocks of about QUERY_BLOCK.

    Each part meets each block in one task. The keys of both sides have one type, as equal numbers of other types are dealt elsewhere."""
    key = F.col("cell").cast("int").alias("cell")
    count = lambda df, n, name: df.groupBy(key).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = F.broadcast(count(cells, rows, "parts").join(count(near, QUERY_BLOCK, "blocks"), "cell"))  # a row a cell
    sided = lambda df: df.withColumn("cell", F.col("cell").cast("int")).join(sizes, "cell")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    left = sided(near).withColumn("block", dealt("qid", "blocks")).withColumn("part", each("parts"))
    right = sided(cells).withColumn("part", dealt("doc_id", "parts")).withColumn("block", each("blocks"))
    return left.drop("parts", "blocks"), right.drop("parts", "blocks")


def probe(cells: DataFrame, centres: DataFrame, queries: DataFrame, k: int = config.TOP_K, nprobe: int = 10) -> DataFrame:
    """Top k of each query among the vectors of its nprobe nearest cells."""
    near = nearest_cells(centres, queries, nprobe).select("qid", "vector", "cell")
    kinds = queries.schema["qid"].dataType.simpleString(), cells.schema["doc_id"].dataType.simpleString()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": a.column("qid").slice(0, 0), "doc_id": b.column("doc_id").slice(0, 0), "score": pa.array([], pa.float64())})
        ids = one_array(b, "doc_id")
        rows, columns, score = scored(matrix(a, "vector"), matrix(b, "vector"), k, "dot", None, places(ids))
        return pa.table({"qid": a.column("qid").take(pa.array(rows)), "doc_id": ids.take(pa.array(columns)), "score": pa.array(score)})

    left, right = spread(near, cells.select("doc_id", "vector", "cell"), BLOCK)
    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"qid {kinds[0]}, doc_id {kinds[1]}, score double")
    return top(found, ["qid"], [F.desc("score"), F.col("doc_id")], k)


def picked(df: DataFrame, most: int, seed: int) -> DataFrame:
    """At most about `most` rows, by a hash of the id."""
    share = min(1.0, most / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))


def lloyd(x: np.ndarray, book: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after some rounds of k-means from `book`."""
    for _ in range(rounds):
        near = nearest_rows(x, book)
        sums, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
        np.add.at(sums, near, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def nearest_rows(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((x**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * x @ book.T).argmin(1)


def parts_of(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The codes of rows: the nearest entry of each part's book."""
    return np.stack([nearest_rows(y, book) for y, book in zip(np.split(x, len(books), axis=1), books)], 1)


def fit_codes(rest: DataFrame, m: int, bits: int, seed: int, turns: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(books, rotation) fitted in one task on a bounded sample of (vector, centre).

    Each of the `turns` re-codes the sample and then takes the rotation that brings it nearest to its codes (the orthogonal
    Procrustes problem); without turns the rotation is the identity."""

    def fit(part: pa.Table) -> pa.Table:
        x = matrix(part, "vector") - matrix(part, "centre")
        x = x[np.lexsort(x.T)]
        rng = np.random.default_rng(seed)
        rotation = np.eye(x.shape[1])
        books = np.stack([y[rng.choice(len(y), 1 << bits, replace=len(y) < 1 << bits)] for y in np.split(x, m, axis=1)])
        for turn in range(turns + 1):
            turned = x @ rotation
            books = np.stack([lloyd(y, book.copy(), 12 if turn == turns else 2) for y, book in zip(np.split(turned, m, axis=1), books)])
            if turn < turns:
                code = parts_of(turned, books)
                u, _, v = np.linalg.svd(x.T @ np.concatenate([books[i][code[:, i]] for i in range(m)], axis=1))
                rotation = u @ v
        return pa.table({"books": [books.astype("<f8").tobytes()], "rotation": [rotation.astype("<f8").tobytes()], "width": pa.array([x.shape[1]], pa.int32())})

    made = rest.select("vector", "centre").groupBy().applyInArrow(fit, "books binary, rotation binary, width int").first()
    width = made["width"]
    return np.frombuffer(made["books"], "<f8").reshape(m, 1 << bits, width // m), np.frombuffer(made["rotation"], "<f8").reshape(width, width)


def code(joined: DataFrame, books: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """(doc_id, vector, cell, code binary) of rows (doc_id, vector, cell, centre). Books and rotation have a fixed size and go to all tasks."""
    m, size, width = books.shape

    def run(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = matrix(part, "vector") - matrix(part, "centre") if batch.num_rows else np.empty((0, m * width))
            codes = parts_of(rest if rotation is None else rest @ rotation, books).astype(np.uint8 if size <= 256 else np.uint16)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary())], names=["doc_id", "vector", "cell", "code"])

    joined = joined.select("doc_id", "vector", "cell", "centre")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema[:3])
    return joined.mapInArrow(run, f"{fields}, code binary")


def build_codes(cells: DataFrame, centres: DataFrame, m: int = 8, bits: int = 8, sample: int = 20_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, vector, cell, code binary) and the code books (m, 2**bits, numbers of a part): product quantisation of what
    vectors differ by from their cell's centre.

    Books are fitted by Lloyd's rounds on at most about `sample` vectors, picked by a hash of the id, in one task; every vector
    is coded. Books have a fixed size and are sent to all tasks."""
    joined = cells.join(F.broadcast(centres), "cell").select("doc_id", "vector", "cell", "centre")  # nlist centres
    books, _ = fit_codes(picked(joined, sample, seed), m, bits, seed)
    return code(joined, books), books


def probe_codes(coded: DataFrame, centres: DataFrame, books: np.ndarray, queries: DataFrame, k: int = config.TOP_K, nprobe: int = 10, refine: int = 10, rotation: np.ndarray | None = None) -> DataFrame:
    """Top k of each query by inner product: refine * k candidates by their codes in the nprobe nearest cells, then by whole vectors."""
    from marlstone.functions.columns import dot

    near = nearest_cells(centres, queries, nprobe).select("qid", F.col("vector").alias("query"), "cell", "near")
    kinds = queries.schema["qid"].dataType.simpleString(), coded.schema["doc_id"].dataType.simpleString()
    m, size, width = books.shape
    kind = np.uint8 if size <= 256 else np.uint16

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": a.column("qid").slice(0, 0), "doc_id": b.column("doc_id").slice(0, 0), "about": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(b.column("code").to_pylist()), kind).reshape(-1, m)
        asked = matrix(a, "query") if rotation is None else matrix(a, "query") @ rotation
        close, ids, n, step, made = a.column("near").to_numpy(), one_array(b, "doc_id"), min(refine * k, len(codes)), max(1, SCORES // max(len(codes), m * size)), []
        place = places(ids)
        for low in range(0, len(asked), step):
            tables = np.einsum("qmw,msw->qms", asked[low : low + step].reshape(-1, m, width), books)
            about = np.repeat(close[low : low + step, None], len(codes), axis=1)
            for i in range(m):
                about += tables[:, i, codes[:, i]]
            cut = np.partition(about, about.shape[1] - n, axis=1)[:, about.shape[1] - n]
            rows, columns = np.nonzero(about >= cut[:, None])
            found = about[rows, columns]
            kept = first(rows, found, None if place is None else place[columns], n)
            made.append((rows[kept] + low, columns[kept], found[kept]))
        rows, columns, about = (np.concatenate(z) for z in zip(*made))
        return pa.table({"qid": a.column("qid").take(pa.array(rows)), "doc_id": ids.take(pa.array(columns)), "about": pa.array(about)})

    left, right = spread(near, coded.select("doc_id", "cell", "code"), PART_ROWS)
    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"qid {kinds[0]}, doc_id {kinds[1]}, about double")
    best = top(found, ["qid"], [F.desc("about"), F.col("doc_id")], refine * k).select("qid", "doc_id")
    whole = best.join(coded.select("doc_id", "vector"), "doc_id").join(queries.select("qid", F.col("vector").alias("query")), "qid")
    return top(whole.select("qid", "doc_id", F.round(dot(F.col("query"), F.col("vector")), 9).alias("score")), ["qid"], [F.desc("score"), F.col("doc_id")], k)


def nlist_for(files: int, nlist: int = 100) -> int:
    """The number of cells for so many corpus files of about 100 documents."""
    estimate = 100 * files
    return min(int(estimate**0.5 * 4), 1000) if nlist == 100 and estimate > 1000 else nlist
