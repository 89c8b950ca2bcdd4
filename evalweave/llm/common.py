"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.session import scratch_path

#: The six ASCII blanks that separate words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage
    is cut, and later reads still prune columns and push filters down."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nested(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``d``, so that names of the caller's columns can't
    clash with those an operator adds."""
    return docs.select(F.struct("*").alias("d"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` does the same, and faster, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def small_batches(spark) -> None:
    """Rows travel to Python in batches of at most 512 and about 16 MB, so that long texts fit
    in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 512:
        spark.conf.set(key, "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], row: str, top: int) -> DataFrame:
    """The first ``top`` rows of each group, with their ``rank``. A group is cut in 64 by
    ``row`` first, so that no task ranks more than a 64th of it."""
    lane = F.pmod(F.xxhash64(row), F.lit(64))
    some = df.withColumn("__lane", lane).withColumn("rank", F.row_number().over(W.partitionBy(*group, "__lane").orderBy(*order)))
    some = some.where(F.col("rank") <= top).drop("rank", "__lane")
    return some.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
