"""Line deduplication over the whole corpus.

Every line becomes a narrow row: two 64-bit hashes of its key, its document and its
place. The rows are range-partitioned by hash and sorted by document and place, and
each partition is streamed: the first document of a key keeps its lines. What comes
back per document is a keep bitmap as runs of kept lines, not the text.

Keys that hold more than a thousandth of all lines (found by a bounded heavy-hitter
sketch) would fill one partition each; their first document is a pre-aggregated
minimum instead. Both ways are exact, so the sketch decides nothing but the way.

Nulls: a null text is one empty line; a null id comes after all others and loses its
lines to any other document. Repeated rows of one id are one document: they keep or
lose a line together. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.llm.common import BLANKS, ascii_lower, nested, pinned

MIN_KEY_CHARS = 10
HOT_SHARE = 1 / 1024
#: Bounds of the sketch, and so of the hot list.
HOT_KEYS, TRACKED = 256, 8192


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text hash) names a row of ``docs``; equal rows share it, and their bitmap."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One narrow row for each line whose key is long enough."""
    lines = _rows(docs, doc_id, text).select("doc_id", "text_hash", F.split("body", "\n", -1).alias("lines"))
    lines = lines.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    lines = lines.select("doc_id", "text_hash", "n_lines", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return lines.select("doc_id", "text_hash", "n_lines", "pos",
                        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot_hashes(keys: DataFrame) -> list[int]:
    """Hashes over the share, at most HOT_KEYS."""
    total = keys.count()
    found = keys.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {TRACKED})").alias("top")).first()["top"] if total else []
    return [x["item"] for x in found or [] if x["item"] is not None and x["count"] > total * HOT_SHARE]


def repeated_lines(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (pinned; it is read three times) whose key an earlier document holds."""
    hot = _hot_hashes(keys)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    order = W.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc_id"), "pos").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    later = ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    # the window asks for its keys together, and the range partitioning grants that
    dropped = keys.where(~is_hot).repartitionByRange("h1", "h2").withColumn(
        "first_doc", F.first("doc_id").over(order)).where(later).drop("first_doc")
    if hot:
        common = keys.where(is_hot)
        first = common.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))  # min skips null ids
        dropped = dropped.unionByName(
            common.join(F.broadcast(first), ["h1", "h2"]).where(later).select(*keys.columns))
    return dropped


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that loses lines: (doc_id, text_hash, n_lines, n_dropped, keep), where
    ``keep`` is the keep bitmap as runs ``(start, length)`` of kept lines, from line 0."""
    keys = pinned(line_keys(docs, doc_id, text), "lines")
    # equal rows give equal places, so a set holds each once
    lost = repeated_lines(keys).groupBy("doc_id", "text_hash").agg(
        F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("lost"))
    return lost.select(
        "doc_id", "text_hash", F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("lost").cast("bigint").alias("n_dropped"),
        F.expr("""filter(transform(sequence(0, size(lost)), i -> named_struct(
            'start', coalesce(get(lost, i - 1) + 1, 0),
            'length', coalesce(get(lost, i), n_lines) - coalesce(get(lost, i - 1) + 1, 0))),
            r -> r.length > 0)""").alias("keep"))


def kept_text(body: Column, keep: Column) -> Column:
    lines = F.split(body, "\n", -1)
    return F.array_join(F.flatten(F.transform(
        keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def with_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, body, n_dropped, keep): the row as a struct, its text, and its bitmap, null if whole.

    Bitmaps grow with the corpus, so they are never broadcast: both sides are shuffled
    by document.
    """
    maps = pinned(keep_bitmaps(docs, doc_id, text), "bitmaps").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_dropped", "keep")
    rows = nested(docs).withColumn("body", F.coalesce(F.col("d")[text], F.lit("")))
    return rows.join(
        maps.hint("merge"),
        F.col("d")[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64("body") == F.col("__hash")), "left",
    ).select("d", "body", "n_dropped", "keep")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: line counts, the digest of the kept text, and the keep runs."""
    rows = with_bitmaps(docs, doc_id, text)
    kept = F.when(F.col("keep").isNull(), F.col("body")).otherwise(kept_text(F.col("body"), F.col("keep")))
    lines = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        F.col("d")[doc_id].alias("doc_id"), lines.cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"), "keep")


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of their texts; all rows stay."""
    rows = with_bitmaps(docs, doc_id, text)
    kept = F.when(F.col("keep").isNull(), F.col("d")[text]).otherwise(kept_text(F.col("body"), F.col("keep")))
    return rows.select(F.col("d").withField(f"`{text}`", kept).alias("d")).select("d.*")
