"""From raw documents to token digests: toxicity, near duplicates, secrets, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again for the next one. All but the last return the columns of documents. Rows that repeat, nulls and empty tables are as
each operator defines them: a null text counts as empty and passes all stages but the choice among equal ones, long texts
are taken whole, an empty table gives an empty result, and columns beyond those of documents stay up to the last stage,
whatever their names. SQL can't express the stages, so the pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, common, minhash, mixing, secrets, toxicity

#: The mixture of the pipeline: nine tenths of the tokens that are left, each document at most once.
MIXTURE = mixing.Mixture(percent=90, epochs=1)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by their kinds."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture draws."""
    return mixing.kept(docs, MIXTURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs, read = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        made = common.stored(stage(spark, docs, sf_dir))
        if read is not None:
            common.released(read)  # nothing reads the stage before any more
        docs = read = made
    return STAGES[-1][1](spark, docs, sf_dir)
