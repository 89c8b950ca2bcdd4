"""All-or-nothing table replacement on plain files.

A version is written to a folder of its own; it becomes the table when its commit is in
the log. Readers take the newest commit, so that they see the old or the new table and never
a part of one. Two writers of one version can't both win: the log has each number once.
Old versions stay for readers that already planned on them, until ``remove_old``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalweave.sinks.commits import Conflict, commit, entries, new_data, remove


def current_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    found = entries(spark, path)
    return (found[-1].number, found[-1].data) if found else (0, None)


def replace_table(df: DataFrame, path: str, after: int | None = None) -> int:
    """Write ``df`` as the next version, and return its number.

    A table that was built from the one before names that version as ``after``: if another
    writer has replaced it meanwhile, nothing changes and Conflict is raised, so that the
    caller builds anew. Without ``after`` the table follows whatever there is.
    """
    spark, data = df.sparkSession, new_data(path)
    df.write.parquet(data)
    version = (current_version(spark, path)[0] if after is None else after) + 1
    while not commit(spark, path, version, "table", data):
        if after is not None:
            raise Conflict(f"version {version} of {path} was written by another")
        version += 1
    return version


def read_table(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The current version, or the one of that number; no rows when nothing was written yet."""
    found = {e.number: e.data for e in entries(spark, path)}
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(found[max(found) if version is None else version])


def remove_old(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400.0) -> None:
    """Delete all versions but the newest ``keep``, and what writers left unfinished a day ago."""
    remove(spark, path, entries(spark, path)[:-max(keep, 1)], older_than)
