"""A training-corpus pipeline over ``documents``: each stage takes what the one before it kept.

Toxic documents go; one document of each group of near duplicates stays; documents that hold a benchmark item go;
secrets are masked in the text; what is left is encoded. Each stage's rows are written as Parquet and read again.

All stages take rows with nulls in any column, and none at all; columns beside doc_id and text are handed on as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talkmill.llm import bpe, decontaminate, minhash, secrets, toxicity
from talkmill.llm.common import shared_dir
from talkmill.llm.entries import TOKENIZER, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted to be toxic go. Null and empty texts stay; equal texts stay or go together."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: of its smallest doc_id (nulls last). Null and empty texts are one class."""
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go. Null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in texts are masked and n_chars counted anew. A null text stays null."""
    return secrets.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each row. A null text has no tokens."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: A trained classifier and sketches are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
