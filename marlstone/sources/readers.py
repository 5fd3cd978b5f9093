"""Reading corpora, queries, judgements, runs, seeds, graphs and learner logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CORPUS = "doc_id string, title string, content string, text string, lang string, concepts array<string>, concept_ids array<string>, difficulty string"
QUERIES = "qid string, id string, query string, text string, lang string"
NODES = "id string, name string, lang string, type string, properties map<string,string>"
EDGES = "source string, target string, type string, weight double, properties struct<weight: double>"
RUN = "qid string, doc_id string, rank int, score double, run_name string"
LOG = "learner_id string, event_type string, concept_id string, timestamp double, success boolean, duration double, query string, lang string, results array<string>, clicked_docs array<string>"
#: File patterns of a corpus folder, the better one first; fixed values.
CORPUS_FILES = ("corpus_*_cleaned.jsonl", "corpus_*.jsonl", "*.jsonl")


def placed(rows: DataFrame) -> DataFrame:
    """rows of files with their place as seq: the file's path, then the block's start in it, then the row within the block.

    Rows of a block are read by one task in their order, so the growing id settles the last part; across files and blocks it
    would not, for Spark deals these out by size."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("seq"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON files with the line's place as seq; bad lines go, or stop the job if strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return placed(spark.read.schema(schema).option("mode", mode).json(paths))


def last_of(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("seq")))).where("__n = 1").drop("__n")


def corpus_files(spark: SparkSession, folder: str, union: bool = False) -> list[str]:
    """The corpus files of a folder in any store: those of the first pattern that matches, or of all in one."""
    jvm = spark._jvm
    found: list[str] = []
    for pattern in CORPUS_FILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        hits = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        found += [x.getPath().toString() for x in hits]
        if found and not union:
            break
    return sorted(set(found))


def corpus(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """Documents; content falls back to text and concepts to concept_ids; the last row of an id wins, in the order of files and lines.

    A document without an id gets one of its place, doc_<digest of file and block>_<number>, so that all such documents stay."""
    rows = json_lines(spark, paths, CORPUS, strict)
    place = W.partitionBy("seq.file", "seq.block").orderBy("seq.row")
    own = F.concat_ws("_", F.lit("doc"), F.substring(F.md5(F.concat_ws(":", "seq.file", F.col("seq.block").cast("string"))), 1, 12), F.row_number().over(place).cast("string"))
    rows = rows.where("doc_id IS NOT NULL").unionByName(rows.where("doc_id IS NULL").withColumn("doc_id", own))
    rows = rows.withColumns({"content": F.coalesce(F.expr("nullif(content, '')"), "text"), "concepts": F.coalesce("concepts", "concept_ids", F.array().cast("array<string>"))})
    return last_of(rows.drop("text", "concept_ids"), ["doc_id"])


def queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, query, lang of JSON lines; text goes before query, the last row of a qid wins."""
    rows = json_lines(spark, path, QUERIES)
    rows = rows.select(F.coalesce("qid", "id").alias("qid"), F.coalesce("text", "query").alias("query"), "lang", "seq")
    return last_of(rows.where("qid IS NOT NULL"), ["qid"]).drop("seq")


def plain_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query a line, numbered from q1."""
    rows = placed(spark.read.text(path)).where("trim(value) <> ''")
    number = F.row_number().over(W.orderBy("seq"))  # a file of queries
    return rows.select(F.concat(F.lit("q"), number).alias("qid"), F.trim("value").alias("query"))


def _fields(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    lines = placed(spark.read.text(path))
    return lines.where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.split(F.trim("value"), separator).alias("f"), "seq")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel of TSV or, by suffix, JSON lines; rows without a whole number as third field go, such as a header."""
    if path.endswith(".jsonl"):
        rows = json_lines(spark, path, "qid string, doc_id string, relevance int").withColumnRenamed("relevance", "rel").where("rel IS NOT NULL")
    else:
        f: Column = F.col("f")
        rows = _fields(spark, path).where(F.size("f") >= 3).select(f[0].alias("qid"), f[1].alias("doc_id"), f[2].try_cast("int").alias("rel"), "seq").where("rel IS NOT NULL")
    return last_of(rows, ["qid", "doc_id"]).select("qid", "doc_id", "rel")


def run(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rank of JSON lines, or of TREC text under any other suffix; ranks are dense places by stable order."""
    if path.endswith(".jsonl"):
        rows = json_lines(spark, path, RUN).select(F.coalesce("qid", F.lit("Q0")).alias("qid"), "doc_id", F.coalesce("rank", F.lit(0)).alias("r"), "seq")
    else:
        f = F.col("f")
        rows = _fields(spark, path, r"\s+").where(F.size("f") >= 6).select(f[0].alias("qid"), f[2].alias("doc_id"), f[3].try_cast("int").alias("r"), "seq")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("r", "seq"))).select("qid", "doc_id", "rank")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """entity1, entity2 of a TSV with comments and blank lines."""
    return _fields(spark, path).where(F.size("f") >= 2).select(F.trim(F.col("f")[0]).alias("entity1"), F.trim(F.col("f")[1]).alias("entity2"))


def nodes(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows = json_lines(spark, path, NODES, strict).where("id IS NOT NULL")
    return rows.withColumn("lang", F.coalesce("lang", F.lit("unknown")))


def edges(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Edges with both ends; a weight may stand at the top or among the properties."""
    rows = json_lines(spark, path, EDGES, strict).where("source IS NOT NULL AND target IS NOT NULL")
    return rows.select("source", "target", F.coalesce("type", F.lit("RELATED_TO")).alias("type"), F.coalesce("weight", "properties.weight", F.lit(1.0)).alias("weight"), "seq")


def learner_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Concept events (view, practice, test) and query events of a learner log; other types are left out."""
    rows = json_lines(spark, path, LOG)
    events = rows.where(F.col("event_type").isin("view", "practice", "test")).select("learner_id", "concept_id", "event_type", F.col("timestamp").alias("ts"), "seq", "success", F.coalesce("duration", F.lit(0.0)).alias("duration"))
    asked = rows.where("event_type = 'query'").select("learner_id", "query", "lang", F.col("timestamp").alias("ts"), "results", "clicked_docs", "seq")
    return events, asked


def mock_corpus(spark: SparkSession, lang: str, n: int = 100) -> DataFrame:
    """n documents over five topics and three difficulties, by their number."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % k + 1).cast("int"))
    topic = pick(("grammar", "conjugation", "vocabulary", "pronunciation", "deep learning"), 5)
    level = pick(("beginner", "intermediate", "advanced"), 3)
    rows = spark.range(n).select("id", topic.alias("topic"), level.alias("difficulty"))
    return rows.select(F.format_string("doc_%s_%06d", F.lit(lang), F.col("id")).alias("doc_id"), "topic", F.concat_ws(" ", F.lit("Lesson on"), "topic").alias("title"), F.format_string("This %s lesson number %d explains %s with examples and exercises.", "difficulty", "id", "topic").alias("content"), F.lit(lang).alias("lang"), F.array("topic").alias("concepts"), "difficulty")


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that sinks.model() wrote."""
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")


#: Names that the generators use; fixed values.
MOCK_CONCEPTS = ("grammar", "conjugation", "vocabulary", "pronunciation")
MOCK_LEARNER = (("alphabet", 0.9, 8), ("pronunciation", 0.8, 6), ("vocabulary_basic", 0.7, 7), ("grammar_basic", 0.6, 5), ("sentence_structure", 0.4, 4), ("vocabulary_advanced", 0.3, 4))


def mock_entities(spark: SparkSession, lang: str, n: int = 20, seed: int = 42) -> DataFrame:
    """Entity batches (doc_id, lang, entities, seq) of n documents with one to three concepts each, chosen by a hash."""
    docs = spark.range(n)
    pick = lambda k: F.element_at(F.array(*map(F.lit, MOCK_CONCEPTS)), (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(len(MOCK_CONCEPTS))) + 1).cast("int"))
    one = lambda k: F.struct(pick(k).alias("text"), F.lit("Concept").alias("type"), F.lit(0).alias("start"), F.length(pick(k)).alias("end"))
    some = F.slice(F.array_distinct(F.array(one(1), one(2), one(3))), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) + 1).cast("int"))
    return docs.select(F.format_string("doc_%s_%06d", F.lit(lang), "id").alias("doc_id"), F.lit(lang).alias("lang"), some.alias("entities"), F.col("id").alias("seq"))


def mock_relations(spark: SparkSession, lang: str, n: int = 20, seed: int = 42) -> DataFrame:
    """Relations (doc_id, lang, head, tail, type) between two different concepts in each of n documents, chosen by a hash."""
    size = len(MOCK_CONCEPTS)
    first = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size))
    second = (first + 1 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(size - 1))) % size
    name = lambda i: F.element_at(F.array(*map(F.lit, MOCK_CONCEPTS)), (i + 1).cast("int"))
    kind = F.when(F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(2)) == 0, "PREREQUISITE").otherwise("RELATED_TO")
    return spark.range(n).select(F.format_string("doc_%s_%06d", F.lit(lang), "id").alias("doc_id"), F.lit(lang).alias("lang"), name(first).alias("head"), name(second).alias("tail"), kind.alias("type"))


def mock_graph(spark: SparkSession, langs: tuple[str, ...] = ("fr", "zh", "en")) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: the concepts in each language, in a chain of prerequisites, aligned with those of the first language."""
    nodes_ = [(f"concept_{c}_{lang}", c, lang, "CONCEPT", i * len(MOCK_CONCEPTS) + j) for i, lang in enumerate(langs) for j, c in enumerate(MOCK_CONCEPTS)]
    chain = [(f"concept_{a}_{lang}", f"concept_{b}_{lang}", "PREREQUISITE", 0.9) for lang in langs for a, b in zip(MOCK_CONCEPTS, MOCK_CONCEPTS[1:])]
    aligned = [(f"concept_{c}_{langs[0]}", f"concept_{c}_{lang}", "ALIGNED_WITH", 1.0) for lang in langs[1:] for c in MOCK_CONCEPTS]
    edges_ = [(*e, i) for i, e in enumerate(chain + aligned)]
    return spark.createDataFrame(nodes_, "id string, name string, lang string, type string, seq long"), spark.createDataFrame(edges_, "source string, target string, type string, weight double, seq long")


def mock_events(spark: SparkSession, learners: int = 3, start: float = 1_700_000_000.0, seed: int = 42) -> DataFrame:
    """Learner events: a view and then exercises of each concept, whose outcome goes by the concept's rate and a hash."""
    plan = F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(rate).alias("rate"), F.lit(n).alias("n"), F.lit(i).alias("i")) for i, (c, rate, n) in enumerate(MOCK_LEARNER)])
    rows = spark.range(1, learners + 1).select(F.col("id").alias("learner_id"), F.explode(plan).alias("p")).select("learner_id", "p.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    chance = F.pmod(F.xxhash64("learner_id", "concept", "k", F.lit(seed)), F.lit(1000)) / 1000.0
    seq = (F.col("learner_id") * 1000 + F.col("i") * 100 + F.col("k")).cast("long")
    return rows.select("learner_id", F.col("concept").alias("concept_id"), F.when(F.col("k") == 0, "view").otherwise("practice").alias("event_type"), (F.lit(start) + F.col("i") * 3600 + F.col("k") * 60).alias("ts"), seq.alias("seq"), F.when(F.col("k") > 0, chance < F.col("rate")).alias("success"), F.when(F.col("k") == 0, 300.0).otherwise(120.0).alias("duration"))
