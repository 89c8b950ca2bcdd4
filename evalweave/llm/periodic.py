"""Runs of words: stretches that repeat a shorter stretch four times or more.

A run is a longest stretch of words in which words ``period`` apart are equal, at least
``max(6, 4 * period)`` words long, where ``period`` is the smallest that fits.

* Periods up to ``SHORT`` are found by comparing the words with themselves at each lag.
* Longer periods are found per scale: those in (m, 2m], m a power of two, by stretches of 2m
  words. Of each m neighbouring stretches the one with the smallest hash is kept. A run is
  long enough to hold such a window and its image one period on, which keep the same
  places; so the run has two kept stretches with equal hash exactly one period apart, and as
  a stretch is no shorter than the period, none between them. Neighbours among the kept
  stretches of equal hash are thus all the seeds there are: fewer than the words over m.
* A seed is extended word by word to both ends, and kept if it is long enough. Hashes only
  propose; the words decide.

Where no stretch of 2m words occurs twice, no longer one does, and larger scales are left out.

One pass, no shuffle: a document is one row, and memory is a few dozen bytes a word of it.
Nulls: a null text has no words and no run; null ids are carried. Empty texts and texts of blanks
have no run. Ties of length go to the smallest start, then period. Repeated rows count each; an
empty table gives an empty result. Columns of ``docs`` but id and text are not read, so that
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import BLANK_RUN, small_batches

LEAST_WORDS, REPEATS = 6, 4
#: Periods up to this many words are found by direct comparison.
SHORT = 8
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RESULT = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"
ARROW_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least_length(period: int) -> int:
    return max(LEAST_WORDS, REPEATS * period)


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def lag_runs(ids: np.ndarray, lag: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that repeat at ``lag`` and are long enough."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + lag
    for k in np.flatnonzero(ends - starts >= least_length(lag)).tolist():
        yield int(starts[k]), int(ends[k])


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * np.uint64(0x9E3779B97F4A7C15) + (right + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Sorted places of the first smallest value of each window; ``width`` is a power of two."""
    at = np.arange(len(values))
    step = 1
    while step < width:
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        step *= 2
    return np.unique(at)


def seeds(hashes: np.ndarray, scale: int) -> np.ndarray:
    """(place, distance) of neighbours among equal minima, ``scale`` to ``2 * scale`` apart."""
    at = window_minima(hashes, scale)
    order = np.argsort(hashes[at], kind="stable")
    at = at[order]
    gap = at[1:] - at[:-1]
    good = (hashes[at[1:]] == hashes[at[:-1]]) & (gap > scale) & (gap <= 2 * scale)
    found = np.stack([at[:-1][good], gap[good]], axis=1)
    return found[np.argsort(found[:, 0], kind="stable")]


def _equal_from(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, by comparing ever longer pieces."""
    n, done, piece = min(len(a), len(b)), 0, 32
    while done < n:
        differ = a[done:done + piece][:n - done] != b[done:done + piece][:n - done]
        if differ.any():
            return done + int(np.argmax(differ))
        done += piece
        piece *= 2
    return n


def extend(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around ``at`` that repeats at ``lag``."""
    right = _equal_from(ids[at:], ids[at + lag:])
    left = _equal_from(ids[:at][::-1], ids[:at + lag][::-1])
    return at - left, at + lag + right


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period."""
    n = len(ids)
    found: dict[tuple[int, int], int] = {}  # a stretch keeps its smallest period
    for lag in range(1, min(SHORT, n // REPEATS) + 1):
        if n >= least_length(lag):
            for span in lag_runs(ids, lag):
                found.setdefault(span, lag)
    scale = SHORT
    if n >= least_length(scale + 1):
        hashes, size = _mix(ids.astype(np.uint64), np.zeros(n, np.uint64)), 1
    while n >= least_length(scale + 1):
        while size < 2 * scale:  # of stretches twice as long
            hashes = _mix(hashes[:-size], hashes[size:])
            size *= 2
        ordered = np.sort(hashes)
        if not (ordered[1:] == ordered[:-1]).any():
            break
        done: dict[int, int] = {}
        longer = []
        for at, lag in seeds(hashes, scale).tolist():
            if at + lag < done.get(lag, 0):  # inside the stretch that an earlier seed found
                continue
            start, end = extend(ids, at, lag)
            done[lag] = end
            if end - start >= least_length(lag):
                longer.append((lag, start, end))
        for lag, start, end in sorted(longer):
            found.setdefault((start, end), lag)
        scale *= 2
    return sorted((a, b - a, lag) for (a, b), lag in found.items())


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words of no run, and those of the first period of one where no other run drops them."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, runs, texts = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = (text.as_py() or b"").split()
            here = find_runs(word_ids(words)) if len(words) >= LEAST_WORDS else []
            sizes.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in here])
            texts.append(b" ".join(kept_words(words, here)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, ARROW_RUN),
             pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length and period in words, by
    start, then period) and ``collapsed``: the text without the words that repeat, joined by blanks."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _find, RESULT)


def longest(runs: str = "runs") -> Column:
    """The longest run of each row; ties to the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as (doc_id, text) where a tenth of the texts, by the crc32 of their id, end in a
    repetition: a test bed with runs of every period."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), BLANK_RUN, -1), lambda w: w != "")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    g, n, a, p = F.col("g"), F.size("w"), F.col("a"), F.col("p")
    rows = rows.withColumn("a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), a), again), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and hashes of what ``find`` returns."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.col("top")
    return found.withColumn("top", longest()).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-top["back"]).alias("start"), top["length"].alias("length"),
        (-top["short"]).alias("period"), F.floor(1000 * top["length"] / -top["short"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
