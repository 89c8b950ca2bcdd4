"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) becomes signed deltas per source,
language and tokenizer version. Additive totals are the sum of all committed deltas, so
a batch costs its own size, never the corpus. A batch is committed under its id: its
deltas go to a folder of their own, and count once the marker file that Spark writes
last is there. Committing an id again changes nothing; a commit that was cut off is
written anew.

Nulls: a null text has no tokens; null source, language or id are keys like others (null
sums with null). Repeated changes in one batch count each, as they are rows of a log; an
empty batch commits nothing but its id. Reading a store without commits gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import BLANK_RUN, BLANKS, small_batches

KEYS = ["source", "lang", "tokenizer"]
#: Columns of a change log; ``old_tokens`` only counts for deletes and revisions.
INSERT, DELETE, REVISE = "insert", "delete", "revise"
DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def word_count(text: Column) -> Column:
    """Tokens of version ``words``: runs of anything but ASCII blanks."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, BLANK_RUN))).cast("bigint")


def _piece_counts(path: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from evalweave.llm.pieces import load
        library = load(path).library
        for texts in batches:
            yield pd.Series([len(x) for x in library.encode([t or "" for t in texts], num_threads=1)], dtype="int64")
    return F.pandas_udf(run, "bigint")


def piece_count(text: Column, model: str) -> Column:
    """Tokens of a SentencePiece model, of the whole text."""
    return _piece_counts(model)(text)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a change log (op, source, lang, tokenizer, tokens, old_tokens).

    Each task sums what it reads first, so a source with a third of the rows is no
    hot key.
    """
    op = F.col("op")
    known = changes.where(op.isin(INSERT, DELETE, REVISE))
    documents = F.when(op == INSERT, 1).when(op == DELETE, -1).otherwise(0)
    tokens = F.when(op == DELETE, 0).otherwise(F.coalesce("tokens", F.lit(0))) - F.when(
        op == INSERT, 0).otherwise(F.coalesce("old_tokens", F.lit(0)))
    return known.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
        F.sum(documents).cast("bigint").alias("documents"), F.sum(tokens).cast("bigint").alias("tokens"))


class Store:
    """Committed deltas under ``path``, one folder for each batch id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Folders with a marker, in order of their ids."""
        if not self.files.exists(self.folder):
            return []
        found = [str(s.getPath()) for s in self.files.listStatus(self.folder) if s.isDirectory()]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(f for f in found if self.files.exists(marker(f"{f}/_SUCCESS")))

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """False if the batch had been committed before; nothing is written then."""
        folder = f"{self.path}/batch={batch_id:012d}"
        if any(f.endswith(f"/batch={batch_id:012d}") for f in self.committed()):
            return False
        deltas(changes).write.mode("overwrite").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens per source, language and tokenizer version; keys whose
        documents and tokens are all gone drop out."""
        folders = self.committed()
        rows = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents != 0 or tokens != 0")


def changes(docs: DataFrame, op: str, tokenizer: str, tokens: Column, old_tokens: Column | None = None,
            source: str = "source", lang: str = "lang") -> DataFrame:
    """A change log row for every row of ``docs``."""
    small_batches(docs.sparkSession)
    return docs.select(F.lit(op).alias("op"), F.col(source).alias("source"), F.col(lang).alias("lang"),
                       F.lit(tokenizer).alias("tokenizer"), tokens.cast("bigint").alias("tokens"),
                       (F.lit(None) if old_tokens is None else old_tokens).cast("bigint").alias("old_tokens"))
