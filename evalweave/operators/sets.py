"""Set operations on tables and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import split_list, unknown_values


def new_runs(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Runs that were not there before; old runs never stand in for new ones."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti")


def ordered_distinct(text: str, allowed: Column) -> tuple[Column, Column]:
    """(words in first-mention order, the words outside the domain)."""
    words = split_list(text)
    return words, unknown_values(words, allowed)


def latest_new_run(files: DataFrame, before: DataFrame) -> DataFrame:
    """Newest new run that has a table with a document of the same stem.

    ``files``: run, stem, kind in (csv, json). One row or none.
    """
    pairs = files.groupBy("run", "stem").agg(
        F.max((F.col("kind") == "csv").cast("int")).alias("c"),
        F.max((F.col("kind") == "json").cast("int")).alias("j"),
    ).where((F.col("c") == 1) & (F.col("j") == 1))
    return new_runs(pairs, before, "run").agg(F.max("run").alias("run")).where("run is not null")
