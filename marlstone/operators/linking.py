"""Entity linking by characters and by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import letter_jaccard, letters, top

FUZZY, STRICT = 0.4, 0.8


#: Letters from rare to frequent in the languages at hand; others are rarer. A fixed order; any would do for right results.
FREQUENT = "qjkzxwyvfbghpmdculoantrsie "


def by_rarity(found: Column) -> Column:
    """A set of characters, the rarest first."""
    return F.transform(F.array_sort(F.transform(found, lambda c: F.struct(F.instr(F.lit(FREQUENT), c).alias("n"), c.alias("c")))), lambda x: x["c"])


def prefix(ordered: Column, threshold: float) -> Column:
    """The characters of which a set with a similarity of the threshold or more to this one has at least one among its own."""
    return F.slice(ordered, 1, (F.size(ordered) - F.ceil(F.lit(threshold - 1e-9) * F.size(ordered)) + 1).cast("int"))


def fuzzy(mentions: DataFrame, nodes: DataFrame, threshold: float = FUZZY, limit: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(mention, *keep, id, similarity, rank): the best nodes for each mention (mention, lang, type) by common characters.

    A null language or type of a mention, or the language 'auto', is no filter. Mentions and nodes meet by the rarest of their
    characters: at a similarity of t two sets have one in common among the first n - t*n + 1 of each. A pair is made at the
    first such character only, if sizes allow it, and then compared."""
    m = mentions.select("mention", "lang", "type").dropDuplicates()
    m = m.select("mention", F.col("lang").alias("lang0"), F.when(F.col("lang") != "auto", F.col("lang")).alias("mlang"), F.col("type").alias("mtype"), by_rarity(letters(F.col("mention"))).alias("ma"))
    n = nodes.select("id", "lang", "type", "seq", by_rarity(letters(F.col("name"))).alias("na"))
    m = m.withColumn("mp", prefix(F.col("ma"), threshold)).withColumn("c", F.explode("mp"))
    n = n.withColumn("np", prefix(F.col("na"), threshold)).withColumn("c", F.explode("np"))
    fit = (F.col("mlang").isNull() | (F.col("mlang") == F.col("lang"))) & (F.col("mtype").isNull() | (F.col("mtype") == F.col("type")))
    sizes = F.least(F.size("ma"), F.size("na")) >= F.lit(threshold - 1e-9) * F.greatest(F.size("ma"), F.size("na"))
    met = m.join(n, "c").where(fit & sizes & (F.element_at(F.array_intersect("mp", "np"), 1) == F.col("c")))
    scored = met.withColumn("similarity", F.round(letter_jaccard(F.col("ma"), F.col("na")), 9)).where(F.col("similarity") >= threshold)
    named = top(scored, ["mention", "lang0", "mtype"], [F.desc("similarity"), F.col("seq")], limit)
    return named.select("mention", *[F.col({"lang": "lang0", "type": "mtype"}[c]).alias(c) for c in keep], "id", "similarity", "rank")


def link(mentions: DataFrame, nodes: DataFrame, threshold: float = FUZZY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The best node of each mention."""
    return fuzzy(mentions, nodes, threshold, 3, keep).where("rank = 1").select("mention", *keep, "id", F.col("similarity").alias("confidence"))


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: Characters of the runs by which a name is found that contains a mention; shorter mentions are found by shorter runs.
GRAM = 4


def containing(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The columns of mentions (mention) and nodes (name) of pairs in which the name contains the mention.

    A name that contains a mention has all its runs of characters; they meet by one of them, the one of least hash."""
    long = F.length("mention")
    run = lambda n: F.array_sort(F.transform(grams(F.col("mention"), n), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    key = F.coalesce(*[F.when(long >= n, F.element_at(run(n), 1)["g"]) for n in range(GRAM, 0, -1)])
    asked = mentions.where("mention <> ''").withColumn("__g", key)
    wanted = asked.select("__g").distinct()
    held = nodes.withColumn("__g", F.explode(F.array_union(F.array_union(grams(F.col("name"), 1), grams(F.col("name"), 2)), F.array_union(grams(F.col("name"), 3), grams(F.col("name"), GRAM)))))
    held = held.join(wanted, "__g", "left_semi")
    return asked.join(held, "__g").where(F.col("name").contains(F.col("mention"))).drop("__g")


def exact_then_fuzzy(mentions: DataFrame, nodes: DataFrame, threshold: float = STRICT, limit: int = 5) -> DataFrame:
    """(mention, id, confidence, method): nodes of exactly this name; for the rest the best of the first `limit` whose name contains the mention."""
    m = mentions.select("mention").distinct()
    exact = m.join(nodes, m["mention"] == nodes["name"]).groupBy("mention").agg(F.min_by("id", "seq").alias("id")).select("mention", "id", F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))
    rest = m.join(exact, "mention", "left_anti")
    near = top(containing(rest, nodes.select("id", "name", "seq")), ["mention"], [F.col("seq")], limit, "n").withColumn("confidence", F.round(letter_jaccard(letters(F.col("mention")), letters(F.col("name"))), 9))
    near = top(near.where(F.col("confidence") >= threshold), ["mention"], [F.desc("confidence"), F.col("seq")], 1)
    return exact.unionByName(near.select("mention", "id", "confidence", F.lit("fuzzy").alias("method")))
