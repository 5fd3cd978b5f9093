"""Mixing sources to target weights by hierarchical budgeting, with DataFrame and SQL operations only.

Leaves are the sources under a language under a domain. A budget of tokens goes down the tree by weights. A node that has
less than its share gives the shortage to its siblings, by their weights, before the ancestors share it out: at each level
the amount is poured in by weight until the smaller children are full. A leaf's budget is met by whole epochs of its
documents and then by a prefix, in tokens, of a further epoch in an order that a hash with the seed gives.

Shares are integers throughout. Texts are read once for their sizes, which are kept as a narrow table; budgets, prefixes and
their ends come from it. Tables with a row for each leaf, as many as there are sources and languages, are written tables
too, so that the optimizer knows their size and broadcasts them only if that is small; nothing comes to the driver. No
leaf's rows are sorted in one task: sums by leaf and hash bucket find the one bucket in which the prefix ends, and only its
rows are ordered.

Nulls: a null text counts as empty, a null source or language as 'unknown'. Empty texts have no tokens and are drawn like
others. Long texts count by their tokens and are drawn in part at the end of a prefix. Repeated rows each count. Rows of one
id are ordered by their tokens; equal ones are alike. An empty table gives one. Other columns are left out by mixed() and
stay in kept(), whatever their names, but for names with two leading underscores, which are this module's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm import common

#: Hexadecimal digits of the order's hash that make a bucket: 65,536 of them in a leaf.
BUCKET_DIGITS = 4
#: Files of a table with a row for each leaf.
LEAF_FILES = 4
LEAF = ["__domain", "__lang", "__source"]


@dataclass(frozen=True)
class Mixture:
    """Weights are integers; a domain or language that isn't listed has the weight of OTHER, sources of a language share alike."""

    domains: dict[str, int] = field(default_factory=lambda: {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    other: int = 5
    percent: int = 60  # of all tokens make the budget
    epochs: int = 2  # at most, of any document
    seed: int = 42


def leaf_columns() -> dict[str, Column]:
    """The path of a row's leaf. A source's domain follows from the number at its end."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("unknown"))
    number = F.regexp_extract(source, "[0-9]{1,9}$", 0)
    domain = F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string"))).otherwise("other")
    return {"__domain": domain, "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "__source": source}


def tokens(text: Column) -> Column:
    """Pieces between white space: one more than its characters, none in an empty text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + 1).cast("long")


def poured(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent, name, __weight, __cap, __amount of the parent) with each child's __take: the amount by weight, no more than its cap, what the full ones leave shared among the rest."""
    order = [F.col("__cap") / F.col("__weight"), F.col(name)]
    before = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    level = children.withColumns({"__before": F.coalesce(F.sum("__cap").over(before), F.lit(0)), "__rest": F.sum("__weight").over(after)})
    level = level.withColumn("__full", F.col("__cap") * F.col("__rest") <= F.col("__weight") * (F.col("__amount") - F.col("__before")))
    everyone = W.partitionBy(*parent)
    first = F.min(F.when(~F.col("__full"), F.struct(F.col("__before").alias("b"), F.negative("__rest").alias("r")))).over(everyone)
    share = F.expr("(__weight * (__amount - __first.b)) div (-__first.r)")
    return level.withColumn("__first", first).withColumn("__take", F.when(F.col("__full"), F.col("__cap")).otherwise(share))


def weights(column: str, given: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for key, value in given.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out.cast("long")


def budgets(narrow: DataFrame, mix: Mixture) -> DataFrame:
    """(domain, language, source, tokens there, budget) of each leaf; one row for each, whatever the corpus."""
    leaves = narrow.groupBy(*LEAF).agg(F.sum("__tokens").alias("__there"))
    leaves = leaves.withColumn("__cap", F.col("__there") * mix.epochs)
    total = W.partitionBy()
    top = leaves.withColumn("__amount", F.expr(f"(sum(__there) over () * {mix.percent}) div 100"))
    domains = top.groupBy("__domain").agg(F.sum("__cap").alias("__cap"), F.first("__amount").alias("__amount")).withColumn("__weight", weights("__domain", mix.domains, mix.other))
    domains = poured(domains.withColumn("__root", F.lit(0)), ["__root"], "__domain").select("__domain", F.col("__take").alias("__amount"))
    langs = leaves.groupBy("__domain", "__lang").agg(F.sum("__cap").alias("__cap")).join(domains, "__domain").withColumn("__weight", weights("__lang", mix.languages, mix.other))
    langs = poured(langs, ["__domain"], "__lang").select("__domain", "__lang", F.col("__take").alias("__amount"))
    sources = leaves.join(langs, ["__domain", "__lang"]).withColumn("__weight", F.lit(1).cast("long"))
    return poured(sources, ["__domain", "__lang"], "__source").select("__domain", "__lang", "__source", "__there", F.col("__take").alias("__budget"))


def leaf_table(small: DataFrame) -> DataFrame:
    """A table with a row for each leaf, written in a few files, so that its size is known to the optimizer."""
    return common.stored(small.coalesce(LEAF_FILES))


def ending(sums: DataFrame, leaf: list[str], finer: DataFrame | None = None) -> DataFrame:
    """The bucket in which each leaf's prefix ends, with the tokens before it; with finer sums given, those of this bucket instead.

    sums: leaf, __want, __b (a bucket, coarse at first), __sum. So no window holds more than a few hundred rows of a leaf."""
    base = F.col("__base") if "__base" in sums.columns else F.lit(0)
    summed = sums.groupBy(*leaf, "__want", "__b", base.alias("__from")).agg(F.sum("__sum").alias("__sum"))
    running = W.partitionBy(*leaf).orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = summed.withColumn("__until", F.col("__from") + F.sum("__sum").over(running)).where("__until >= __want")
    last = reached.groupBy(*leaf).agg(F.min(F.struct("__b", (F.col("__until") - F.col("__sum")).alias("b"))).alias("e"))
    last = last.select(*leaf, F.col("e.__b").alias("__last"), F.col("e.b").alias("__base"))
    if finer is None:
        return last
    inside = F.substring("__bucket", 1, BUCKET_DIGITS // 2) == F.col("__last")
    return finer.join(last, leaf).where(inside).select(*leaf, "__want", "__base", F.col("__bucket").alias("__b"), "__sum")


def sized(docs: DataFrame) -> DataFrame:
    """docs with the columns of their leaf and __tokens."""
    return docs.withColumns(leaf_columns()).withColumn("__tokens", tokens(common.clean_text()))


def planned(rows: DataFrame, narrow: DataFrame, mix: Mixture) -> DataFrame:
    """rows with the columns __full (whole epochs taken) and __part (tokens taken of one more epoch, null if none).

    rows and narrow have doc_id, LEAF and __tokens of the same documents; narrow, a written table, is read for all sums."""
    plan = budgets(narrow, mix).withColumn("__full", F.expr("CASE WHEN __there = 0 THEN 0 ELSE __budget div __there END"))
    plan = leaf_table(plan.select(*LEAF, "__full", (F.col("__budget") - F.col("__full") * F.col("__there")).alias("__want")))

    def keyed(table: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), (F.col("__full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        return table.join(plan, LEAF).withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))

    sums = keyed(narrow).where("__want > 0").groupBy(*LEAF, "__want", "__bucket").agg(F.sum("__tokens").alias("__sum"))
    ends = ending(ending(sums.withColumn("__b", F.substring("__bucket", 1, BUCKET_DIGITS // 2)), LEAF, sums), LEAF)
    placed = keyed(rows).join(leaf_table(ends.select(*LEAF, "__last", "__base")), LEAF, "left")
    inside = placed.where("__bucket = __last")
    order = W.partitionBy(*LEAF).orderBy("__key", "doc_id", "__tokens").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("__before", F.col("__base") + F.coalesce(F.sum("__tokens").over(order), F.lit(0)))
    inside = inside.withColumn("__part", F.when(F.col("__before") < F.col("__want"), F.least("__tokens", F.col("__want") - F.col("__before"))))
    outside = placed.where("__last IS NULL OR __bucket <> __last").withColumn("__before", F.lit(None).cast("long"))
    outside = outside.withColumn("__part", F.when(F.col("__bucket") < F.col("__last"), F.col("__tokens")))
    return outside.unionByName(inside)


def mixed(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """doc_id, lang, source, epoch, n_tokens taken: a row for each time that a document is drawn."""
    narrow = common.stored(sized(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    rows = planned(narrow, narrow, mix)
    drawn = F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(mix.epochs + 1)), lambda e: F.when(e <= F.col("__full"), F.struct(e.cast("long").alias("epoch"), F.col("__tokens").alias("n_tokens")))),
        F.array(F.when(F.col("__part").isNotNull(), F.struct((F.col("__full") + 1).cast("long").alias("epoch"), F.col("__part").alias("n_tokens")))),
    )
    return rows.select("doc_id", "lang", "source", F.explode(F.filter(drawn, lambda x: x.isNotNull())).alias("d")).select("doc_id", "lang", "source", "d.epoch", "d.n_tokens")


def kept(docs: DataFrame, mix: Mixture) -> DataFrame:
    """The rows of docs that a mixture of one epoch draws, whole, with their own columns."""
    once = Mixture(mix.domains, mix.languages, mix.other, mix.percent, 1, mix.seed)
    rows = sized(docs)
    narrow = common.stored(rows.select("doc_id", *LEAF, "__tokens"))
    return planned(rows, narrow, once).where("__full > 0 OR __part IS NOT NULL").select(*[f"`{c}`" for c in docs.columns])


def oracle(mix: Mixture = Mixture()) -> str:
    """mixed() in DuckDB SQL."""
    listed = lambda column, given: "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in given.items()) + f" ELSE {mix.other} END"

    def pour(source: str, parent: str, name: str) -> str:
        return f"""
        (SELECT *, CASE WHEN is_full THEN cap ELSE (weight * (amount - min(CASE WHEN NOT is_full THEN bef END) OVER (PARTITION BY {parent}))) // max(CASE WHEN NOT is_full THEN rest END) OVER (PARTITION BY {parent}) END AS take
         FROM (SELECT *, cap * rest <= weight * (amount - bef) AS is_full
               FROM (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
                               sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({source}))))"""

    return f"""
    WITH sized AS (
      SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s,
             CASE WHEN regexp_extract(coalesce(source, 'unknown'), '[0-9]{{1,9}}$') <> '' THEN 'domain' || (regexp_extract(coalesce(source, 'unknown'), '[0-9]{{1,9}}$')::INT % 4) ELSE 'other' END AS d,
             (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(translate(text, ' ' || chr(10) || chr(9) || chr(13), '')) + 1 END)::BIGINT AS tokens FROM documents),
    leaves AS (SELECT d, l, s, sum(tokens)::BIGINT AS there, (sum(tokens) * {mix.epochs})::BIGINT AS cap FROM sized GROUP BY ALL),
    domains AS (SELECT d, take AS amount FROM {pour(f"SELECT d, 0 AS root, sum(cap)::BIGINT AS cap, (SELECT (sum(there) * {mix.percent} // 100)::BIGINT FROM leaves) AS amount, ({listed('d', mix.domains)})::BIGINT AS weight FROM leaves GROUP BY d", "root", "d")}),
    langs AS (SELECT d, l, take AS amount FROM {pour(f"SELECT d, l, cap, amount, ({listed('l', mix.languages)})::BIGINT AS weight FROM (SELECT d, l, sum(cap)::BIGINT AS cap FROM leaves GROUP BY d, l) JOIN domains USING (d)", "d", "l")}),
    budget AS (SELECT d, l, s, there, take AS budget FROM {pour("SELECT d, l, s, there, cap, amount, 1::BIGINT AS weight FROM leaves JOIN langs USING (d, l)", "d, l", "s")}),
    plan AS (SELECT d, l, s, CASE WHEN there = 0 THEN 0 ELSE budget // there END AS fulls, budget - (CASE WHEN there = 0 THEN 0 ELSE budget // there END) * there AS want FROM budget),
    ordered AS (SELECT z.*, fulls, want, coalesce(sum(tokens) OVER (PARTITION BY d, l, s ORDER BY md5('{mix.seed}:' || (fulls + 1)::BIGINT::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
                FROM sized z JOIN plan USING (d, l, s)),
    drawn AS (SELECT doc_id, lang, source, e AS epoch, tokens AS n_tokens FROM ordered, range(1, {mix.epochs + 2}) g(e) WHERE e <= fulls
              UNION ALL SELECT doc_id, lang, source, fulls + 1, least(tokens, want - bef) FROM ordered WHERE want > 0 AND bef < want)
    SELECT doc_id, lang, source, epoch::BIGINT AS epoch, n_tokens::BIGINT AS n_tokens FROM drawn
    """
