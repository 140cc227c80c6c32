"""A training corpus from documents: toxicity, SimHash near-dedup, benchmark decontamination, piece encoding.

Every stage is written as Parquet and read again by the next, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, near_dups, piece_codec, toxicity
from plumbline.llm.common import release, spool, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on the labels doesn't predict to be toxic."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return near_dups.deduplicate(docs)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.reject_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of the piece ids, their spans and their decoding."""
    return piece_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", reject_leaks),
    ("sentencepiece encoding and decoding", encode),
]
#: SQL can't express trained models, piece merges or walks: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; only the output of one stage is kept in the shared folder at a time. No documents give no rows."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
