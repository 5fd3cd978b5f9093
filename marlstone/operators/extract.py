"""Entities by gazetteer, relations by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relation patterns in their order: (relation, flags, pattern with two groups). Fixed values; the Chinese ones mind case.
PATTERNS = (
    ("prerequisite", "(?iu)", r"(\w+)\s+(?:avant|précède|nécessite)\s+(\w+)"),
    ("prerequisite", "(?iu)", r"pour\s+(?:apprendre|comprendre)\s+(\w+),\s+(?:il faut|on doit)\s+(?:connaître|maîtriser)\s+(\w+)"),
    ("prerequisite", "", r"(\S+)(?:是|为)(\S+)的(?:基础|前提|先决条件)"),
    ("prerequisite", "", r"学习(\S+)(?:之前|前)需要(?:掌握|了解)(\S+)"),
    ("prerequisite", "", r"(\S+)→(\S+)"),
    ("prerequisite", "(?iu)", r"(\w+)\s+(?:before|precedes|requires)\s+(\w+)"),
    ("prerequisite", "(?iu)", r"(\w+)\s+is\s+(?:a\s+)?prerequisite\s+(?:for|of)\s+(\w+)"),
    ("related_to", "(?iu)", r"(\w+)\s+(?:et|ou)\s+(\w+)\s+sont\s+(?:liés|similaires)"),
    ("related_to", "(?iu)", r"(\w+)\s+(?:concerne|se rapporte à)\s+(\w+)"),
    ("related_to", "", r"(\S+)(?:与|和)(\S+)(?:相关|有关|类似)"),
    ("related_to", "", r"(\S+)(?:涉及|包含)(\S+)"),
    ("related_to", "(?iu)", r"(\w+)\s+(?:and|or)\s+(\w+)\s+are\s+related"),
    ("related_to", "(?iu)", r"(\w+)\s+(?:relates to|concerns)\s+(\w+)"),
    ("has_resource", "(?iu)", r"(\S+):\s*(.+?\.(?:pdf|doc|html|mp4))"),
    ("has_resource", "(?iu)", r"资源.*?(\S+).*?(doc_\d+)"),
)
CONFIDENCE = 0.8
#: Entity types of the recognisers by their own labels; any other label is a Concept. Fixed values.
ENTITY_TYPES = {"PER": "Person", "PERSON": "Person", "LOC": "Location", "LOCATION": "Location", "GPE": "Location", "ORG": "Organization", "ORGANIZATION": "Organization", "TIME": "Time", "DATE": "Time"}


def relations(docs: DataFrame, patterns=PATTERNS) -> DataFrame:
    """(doc_id, relation, source, target, confidence, method): each pattern's matches, the first of equal ones in a document.

    All patterns run over a row at once, so that a document is read once and equal relations meet in its own array."""
    word = lambda p: p.replace(r"\w", r"[\pL\pM\pN\p{Pc}]").replace(r"\S", r"[^\s]")
    text = F.coalesce(F.col("content"), F.lit(""))
    found = []
    for relation, flags, pattern in patterns:
        full = F.lit(flags + word(pattern))
        whole = F.regexp_extract_all(text, full, F.lit(0))  # the groups are found again within each match
        found.append(F.transform(whole, _named(relation, flags + word(pattern))))
    every = F.array_distinct(F.flatten(F.array(*found)))
    rows = docs.select("doc_id", F.posexplode(every).alias("ord", "r"))
    return rows.select("doc_id", "r.relation", "r.source", "r.target", F.lit(CONFIDENCE).alias("confidence"), F.lit("rule").alias("method"))


def _named(relation: str, pattern: str):
    return lambda match: F.struct(F.lit(relation).alias("relation"), F.regexp_extract(match, pattern, 1).alias("source"), F.regexp_extract(match, pattern, 2).alias("target"))


def with_entities(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """docs with the entities of their batch, an empty list where there is none."""
    return docs.join(entities.select("doc_id", "entities"), "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(entities.schema["entities"].dataType)))


def relations_of_entities(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of the documents that have text and at least one entity (entities: doc_id, entities)."""
    some = entities.where(F.size("entities") > 0).select("doc_id")
    return relations(docs.where(F.coalesce("content", F.lit("")) != "").join(some, "doc_id", "left_semi"))


def gazetteer(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, lang, text, type, score, start, end): mentions of known names (name, type), whole words, with the place of the first.

    Words of a document are joined with names by equality, so it scales with both; a model can take the place of this function."""
    from marlstone.functions.columns import words

    found = docs.select("doc_id", "lang", F.col("content"), F.explode(F.array_distinct(words(F.coalesce(F.col("content"), F.lit(""))))).alias("word"))
    known = names.select(F.lower("name").alias("word"), "name", "type").dropDuplicates(["word"])
    hits = found.select("doc_id", "lang", "word", F.expr("instr(lower(content), word)").alias("at")).join(known, "word")
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in ENTITY_TYPES.items()], F.lit("Concept"))
    return hits.select("doc_id", "lang", F.col("name").alias("text"), kind.alias("type"), F.lit(1.0).alias("score"), (F.col("at") - 1).cast("int").alias("start"), (F.col("at") - 1 + F.length("name")).cast("int").alias("end"))


def batched(mentions: DataFrame) -> DataFrame:
    """(doc_id, lang, entities) from single mentions."""
    return mentions.groupBy("doc_id", "lang").agg(F.sort_array(F.collect_list(F.struct("start", "text", "type", "score", "end"))).alias("entities"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
