"""From raw documents to a training mix: language ID, near-dedup, decontamination, secrets, mixing.

Every stage takes all rows that the stage before kept, written as Parquet and read again. All but the
last return the columns of documents; further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import decontam, minhash, mixing, ppm_lang, secrets
from timeweave.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, texts without letters, random
    letters, languages not learned. Very long texts are judged whole, repeated rows alike."""
    return ppm_lang.reject_unknown(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, likeness 0.8); rows equal in doc_id
    and text are one document; rows with a null doc_id and texts without words stay."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none, repeated rows go together."""
    return decontam.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked; null and empty texts have none, repeated rows are
    masked alike."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row a slot, with its block of text and the documents it is made of. Null and
    empty texts are never taken, repeated rows are documents of their own, a null source is a source;
    from an empty table comes an empty mix."""
    return mixing.mixed_blocks(mixing.mix_plan(docs), docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("mix", mix),
]

# Code lengths, hashing, alignment and seeded draws are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
