"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.llm import exact_dedup, minhash, mixing
from tablemirror.llm.common import discard, free_name, shared_dir, small_batches, written
from tablemirror.llm.queries import MAX_REPEATS, TOXIC_SCORE, bpe_digests, toxicity_model

#: Near copies in a corpus are documents whose five-word shingles have a similarity of 0.8 or more.
NEAR_PERCENT = 80


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Null and empty texts are scored as empty; repeated rows each have their score. If no
    row is labelled both ways the score is the share of toxic labels, 0 without labels.
    """
    out = free_name(docs, "__toxicity")
    return toxicity_model(spark, docs, sf_dir).score(docs, out=out).where(F.col(out) < TOXIC_SCORE).drop(out)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the least id; null and empty texts are one group."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the least id; texts without words all stay."""
    with small_batches(spark):
        return minhash.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: every one at least once, no source more than twice as often as another.

    Texts without words, and sources of nothing else, are read once a pass.
    """
    return mixing.mix_rows(docs, "doc_id", "source", mixing.word_tokens(F.col("text")), max_repeats=MAX_REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every reading, checked by what they decode to; null and empty texts have none.

    Written at once, because the texts travel to Python in small batches: beside the
    encoder's tables, 10,000 texts at a time on both sides are too much for an executor.
    """
    with small_batches(spark):
        return written(bpe_digests(docs), "encoded")[0]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mix),
    ("encode", encode),
]

#: SQL can express neither the learned scores, the densified sketches nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stages between are written to the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/llm/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
