"""Cleaning, validity, word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import config
from marlstone.functions.columns import words

#: What is deleted, by language; fixed values. Chinese keeps its own punctuation but neither apostrophe nor hyphen.
KEEP_LATIN = r"""[^a-zA-ZÀ-ÿ0-9\s,.!?;:()'"«»-]"""
KEEP_CHINESE = r"""[^一-鿿　-〿a-zA-Z0-9\s,.!?;:()"《》【】]"""


def clean(text: Column, lang: Column | str = "fr") -> Column:
    """White space to single spaces, then characters outside the language's list go; null gives an empty text."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.trim(F.when(lang == "zh", F.regexp_replace(flat, KEEP_CHINESE, "")).otherwise(F.regexp_replace(flat, "(?U)" + KEEP_LATIN, "")))


def is_valid(content: Column) -> Column:
    low, high = config.CONTENT_LENGTH
    return content.isNotNull() & F.length(content).between(low, high)


def clean_corpus(docs: DataFrame) -> DataFrame:
    """Cleaned title and content of each document that is valid after cleaning; a missing id is made from language and line."""
    out = docs.withColumns({"title": clean(F.col("title"), F.col("lang")), "content": clean(F.col("content"), F.col("lang"))})
    if "line_no" in docs.columns:
        out = out.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.format_string("doc_%s_%06d", "lang", "line_no")))
    return out.where(is_valid(F.col("content")))


def validity_counts(docs: DataFrame) -> DataFrame:
    """Numbers of valid and invalid documents."""
    ok = is_valid(clean(F.col("content"), F.col("lang")))
    return docs.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def postings(docs: DataFrame, fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """(field, term, doc_id, tf): the inverted index as a table. Map-side partial counts keep the shuffle to distinct terms."""
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for f in fields]))
    tokens = docs.select("doc_id", texts.alias("t")).select("doc_id", "t.field", F.explode(words(F.col("t.value"))).alias("term"))
    return tokens.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, fields: tuple[str, ...] = ("title", "content")) -> DataFrame:
    """(field, doc_id, len) in words."""
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(words(F.coalesce(F.col(f), F.lit("")))).alias("len")) for f in fields]))
    return docs.select("doc_id", texts.alias("t")).select("t.field", "doc_id", F.col("t.len").cast("long").alias("len"))
