"""The corpus pipeline: documents in, token ids out.

Each stage works on all that its predecessor kept, and is written as Parquet before the
next one reads it.

Nulls: a document without text fails the quality rules and goes; one without an id takes
part in every stage, loses its repeated lines to documents with an id, and stays only where
no document with an id is its near copy. Empty texts and texts under fifty words go; a
document whose lines all stand in earlier ones stays, empty. Very long texts are treated
whole. Ties: of near copies the smallest id stays, then the smallest hash of the text, then of
all columns. Repeated rows are near copies of each other, so one stays. An empty table gives an
empty result. Other columns of ``documents`` pass through, whatever their names, until the
last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm import decontam, linededup, nearjoin, pieces, quality
from evalweave.llm.common import pinned, table
from evalweave.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines an earlier document holds; their length follows."""
    return linededup.apply(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, 0.8."""
    return nearjoin.first_of_group(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Near copies and token ids are beyond SQL; tests/llm holds the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
