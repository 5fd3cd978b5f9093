"""Target-distribution importance resampling: documents whose n-grams look like a target's are drawn more often.

Features are runs of one to three words, hashed into buckets. A bucket's gain is the logarithm of its share in the target over
its share in the corpus, both smoothed; a document's weight is the sum of its features' gains. Drawing the highest sums of weight
and Gumbel noise, which depends on the seed and the document's id only, is drawing without replacement in proportion to
exp(weight / 1000).

Long texts are cut at word boundaries into overlapping chunks: a chunk carries the next n - 1 words, but owns only the runs that
start in its own part, so each run counts once. Chunks of long texts are dealt out over tasks; a short text is one chunk where it
stands. Bucket counts and weights are made for chunks and summed, by bucket in each task and by document. Only the table of
gains (one row a bucket) goes to the driver and to all tasks. The order of the draw comes from ranges of scores: a place within a
range plus the rows of the ranges before.

Nulls: a null text has no words, a null id is hashed as an empty one and comes before others among ties. Documents without words
have weight 0 and are never drawn, as are those of fewer than MIN_WORDS words. Rows are documents, also if ids or texts repeat:
such rows have the same weight and score, ties go to the smaller id, and which of rows alike in score and id is drawn makes no
difference. Very long words are hashed like others. An empty table gives no rows, an empty target gains for rare
buckets. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import common

BUCKETS = 10_000
#: Words of a run at most; percent of the documents that are drawn; words that a drawn document has at least; the seed of the noise.
NGRAM, PERCENT, MIN_WORDS, SEED = 3, 5, 20, 42
#: Characters of a text that are one chunk, words of a chunk of a longer one, and characters in which words are looked for at once.
SHORT, CHUNK_WORDS, WINDOW = 100_000, 8_192, 1 << 20
#: Bytes of a word up to which all words are hashed side by side.
SIDE_BY_SIDE = 48
#: Bytes that belong to words: digits, letters in lower case and all beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words in lower-case bytes."""
    edge = np.diff(np.concatenate([[False], WORD_BYTES[data], [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _carried_on(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what gave crc, followed by the bytes of each word."""
    state, lengths = ~crc, ends - starts
    order = np.argsort(-lengths, kind="stable")
    longest = lengths[order]
    many = np.searchsorted(-longest, -np.arange(1, SIDE_BY_SIDE + 1), "right")  # words of at least so many bytes
    for i, n in enumerate(many.tolist()):
        if not n:
            break
        at = order[:n]
        state[at] = CRC[(state[at] ^ data[starts[at] + i]) & 255] ^ (state[at] >> 8)
    out = ~state
    for i in np.flatnonzero(lengths > SIDE_BY_SIDE).tolist():
        out[i] = zlib.crc32(data[starts[i] + SIDE_BY_SIDE : ends[i]], int(out[i]))
    return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, owned: np.ndarray, counts: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, chunk) of all runs of up to n words that begin in a chunk's own part.

    Chunk i has the words first[i] to first[i] + counts[i], and owns those before first[i] + owned[i]."""
    last = np.repeat(first + counts, counts)  # where a word's chunk ends
    chunk = np.repeat(np.arange(len(first)), counts)
    own = np.arange(len(starts)) - first[chunk] < owned[chunk]
    crc = np.zeros(len(starts), np.uint32)
    at = np.flatnonzero(own)  # where runs start that go on
    made = []
    for k in range(n):
        at = at[at + k < last[at]]
        if k:  # a blank joins words
            state = ~crc[at]
            crc[at] = ~(CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8))
        crc[at] = _carried_on(crc[at], data, starts[at + k], ends[at + k])
        made.append((crc[at] % np.uint32(buckets), chunk[at]))
    return tuple(np.concatenate(x) for x in zip(*made))


class Chunk:
    """Texts of a batch that are chunks, as one array of bytes; parts of longer texts are (bytes, words of their own)."""

    def __init__(self, texts: list[bytes], owned: list[int | None]):
        joined = np.frombuffer(b"\0".join(texts), np.uint8)
        self.data = LOWER[joined]
        self.starts, self.ends = words(self.data)
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        edges = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.first, self.counts = edges[:-1], np.diff(edges)
        self.owned = np.array([c if o is None else min(o, c) for o, c in zip(owned, self.counts.tolist())], np.int64)

    def features(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        return features(self.data, self.starts, self.ends, self.first, self.owned, self.counts, n, buckets)


def parts(text: str, n: int, size: int = CHUNK_WORDS) -> Iterator[tuple[bytes, int]]:
    """(bytes, owned words) of a long text's chunks, with its last n - 1 words carried; only some of it is held as bytes at once."""
    held, at, length = b"", 0, len(text)
    while at < length:
        held += text[at : at + WINDOW].encode("utf-8", "replace")
        at += WINDOW
        starts, ends = words(LOWER[np.frombuffer(held, np.uint8)])
        whole = len(starts) if at >= length else len(starts) - 1  # the last one may go on
        i = 0
        while whole - i > size + n - 1:
            yield held[starts[i] : ends[i + size + n - 2]], size
            i += size
        if at >= length:
            if i < len(starts):
                yield held[starts[i] : ends[-1]], len(starts) - i
        elif i < len(starts):
            held = held[starts[i] :]
        else:
            held = b""


def chunks(docs: DataFrame, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id, part binary, owned int) of short texts, which are one chunk and stay where they are, and of the parts of long ones, dealt out.

    owned is null for a whole text. row tells rows apart within one run of a plan, and is told anew in each."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), common.clean_text(text_col).alias("text"))
    short = rows.where(F.length("text") <= SHORT).select("row", "id", F.col("text").cast("binary").alias("part"), F.lit(None).cast("int").alias("owned"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "part", "owned"]
        for batch in batches:
            for i in range(batch.num_rows):
                made, size = [], 0
                for j, (part, owned) in enumerate(parts(batch.column(2)[i].as_py(), n)):
                    made.append((part, owned))
                    size += len(part)
                    if size > common.BATCH_BYTES:
                        yield _parts(batch, i, made, names)
                        made, size = [], 0
                if made:
                    yield _parts(batch, i, made, names)

    kind = rows.schema["id"].dataType.simpleString()
    long = rows.where(F.length("text") > SHORT).mapInArrow(cut, f"row long, id {kind}, part binary, owned int")
    return short, long.repartition(F.xxhash64("row", "part"))


def _parts(batch: pa.RecordBatch, i: int, made: list, names: list[str]) -> pa.RecordBatch:
    take = pa.array([i] * len(made))
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.int32())], names=names)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, Chunk(batch.column("part").to_pylist(), batch.column("owned").to_pylist())


def bucket_counts(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, features) of all texts, counted in each task before buckets meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, chunk in _batches(batches):
            total += np.bincount(chunk.features(n, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "features"])

    made = [x.select("part", "owned").mapInArrow(common.frugal(count), "bucket int, features long") for x in chunks(docs.withColumn("__id", F.lit(0)) if "__id" not in docs.columns else docs, n, "__id", text_col)]
    return made[0].unionByName(made[1]).groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, gain long) of every bucket: thousandths of the logarithm of target over corpus, smoothed by one."""
    spark = docs.sparkSession
    counted = bucket_counts(docs, n, buckets, text_col).withColumn("s", F.col("features")).withColumn("t", F.lit(0).cast("long"))
    aimed = bucket_counts(target, n, buckets, text_col).withColumn("s", F.lit(0).cast("long")).withColumn("t", F.col("features"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = counted.select("bucket", "s", "t").unionByName(aimed.select("bucket", "s", "t")).unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = both.withColumns({"all_s": F.sum("s").over(W.partitionBy()), "all_t": F.sum("t").over(W.partitionBy())})  # one row a bucket
    d = lambda x: F.col(x).cast("double")
    share = (d("t") + 1.0) * (d("all_s") + float(buckets)) / ((d("s") + 1.0) * (d("all_t") + float(buckets)))
    return whole.select("bucket", F.floor(F.log(share) * 1000.0).cast("long").alias("gain"))


def weights(docs: DataFrame, table: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight) of each row of docs; table: gains()."""
    values = np.zeros(buckets, np.int64)
    for r in table.collect():  # one row a bucket
        values[r["bucket"]] = r["gain"]
    sent = docs.sparkSession.sparkContext.broadcast(values.tobytes())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(sent.value, np.int64)
        for batch, chunk in _batches(batches):
            bucket, of = chunk.features(n, buckets)
            size = np.bincount(of, minlength=batch.num_rows)
            order = np.argsort(of, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(chunk.owned), pa.array(sums[ends] - sums[ends - size])], names=["row", "id", "n_features", "n_words", "weight"])

    short, long = chunks(docs, n, id_col, text_col)
    schema = f"row long, id {short.schema['id'].dataType.simpleString()}, n_features long, n_words long, weight long"
    short, long = (x.mapInArrow(common.frugal(weigh), schema) for x in (short, long))
    summed = long.groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in ("n_features", "n_words", "weight")])
    return short.unionByName(summed).drop("row")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a digest of seed and id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def drawn(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score and rank (null where not drawn): of the N documents of min_words the floor(percent * N / 100) best."""
    scored = common.stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    taking = scored.where(F.col("n_words") >= min_words)
    best = (F.desc("score"), F.col("id").asc_nulls_first())
    # places within ranges of scores; rows alike are divided by chance
    ranged = taking.repartitionByRange(*best, F.rand(3)).sortWithinPartitions(*best)
    placed = common.stored(ranged.withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # one row for each task that sorted
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("whole"))
    ranked = placed.withColumn("part", part).join(before, "part").withColumn("rank", (F.col("before") + within + 1).cast("long"))
    take = F.floor(F.col("whole") * percent / 100)
    done = ranked.select(*weighed.columns, "score", F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return done.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n: int = NGRAM, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, n_words, weight, score, rank) of each document; rank says in which place it is drawn, null if it isn't."""
    table = common.stored(gains(docs, target, n, buckets, text_col))
    return drawn(weights(docs, table, n, buckets, id_col, text_col), percent, min_words, seed)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document."""
    return resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB SQL for the rows of report()."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(256) r(i)
),
docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (
  SELECT n, array_to_string(w[i:i + k], ' ') AS f FROM (SELECT n, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM docs, range(0, {NGRAM}) r(k))
),
aimed AS (
  SELECT array_to_string(w[i:i + k], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 1)) AS i FROM aims, range(0, {NGRAM}) r(k))
),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM aimed)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1]), 4294967295::BIGINT)) % {BUCKETS} AS b
  FROM bytes, crc_table
),
per_run AS (SELECT n, b FROM runs JOIN hashed USING (f)),
s AS (SELECT b, count(*) AS s FROM per_run GROUP BY b),
t AS (SELECT b, count(*) AS t FROM aimed JOIN hashed USING (f) GROUP BY b),
gain AS (
  SELECT r.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(b) LEFT JOIN s ON r.b = s.b LEFT JOIN t ON r.b = t.b
),
weighed AS (SELECT n, count(*) AS n_features, sum(gain) AS weight FROM per_run JOIN gain USING (b) GROUP BY n),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (n)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY words >= {MIN_WORDS}) AS of FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN words >= {MIN_WORDS} AND place <= {PERCENT} * of // 100 THEN place END AS rank FROM ranked"""
