"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Items become hashed word n-grams; a bitmap of fixed size filters the corpus, so only
   n-grams that (almost surely) occur in an item leave their document.
2. An n-gram is a seed if few items hold it (``FEW_ITEMS``) or few different texts do
   (``FEW_TEXTS``); what is common to many of both joins nothing. All such n-grams are seeds,
   not only the rarest of an item, so that copies of an item can't displace what an edited
   copy of it has kept. A candidate has two seeds, or one that few texts hold. Seeds are
   aggregated per document, item and group of near diagonals before they are shuffled.
3. A window around the seeds, as wide as an alignment through them can reach, is cut out of
   the document, and aligned to the item word by word, if it holds enough of the item's
   words; the score is the local alignment score over what a full match would give. Tables of
   the alignment are kept a row at a time.

A copy that keeps no three words of an item in a row, or only such that are common to many
items and texts, has no seed and is not found. Of equal scores the first place in the
document counts. Very long texts and items cost time by their product, but memory by their sum.

Nulls: null texts and items have no words; null ids are carried. Items under
``MIN_ITEM_WORDS`` words can't be told from chance and are not searched. Repeated items
count once, repeated documents each. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import nested, pinned, small_batches
from evalweave.operators.sizes import measured

NGRAM = 3
MIN_ITEM_WORDS = 5
MIN_SCORE = 0.5
MIN_MATCHES = 5
MISMATCH = GAP = 0.5
#: Seeds are n-grams in at most so many items, or in at most so many different texts.
FEW_ITEMS, FEW_TEXTS = 8, 64
#: Bits of the filter; its 8 MB don't grow with the benchmark.
FILTER_BITS = 26
#: Seeds within this many diagonals are aligned together; windows are joined up to so many words.
DIAGONALS, WINDOW = 32, 4096
PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and blanks separate them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split() if text else []


def ngram_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(h) - NGRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(NGRAM):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for item, text in zip(batch["item_key"], batch["text"]):
            words = words_of(text)
            if len(words) >= MIN_ITEM_WORDS:
                grams = ngram_hashes(words)
                yield pd.DataFrame({"gram": grams, "item_key": item, "at": np.arange(len(grams), dtype=np.int32),
                                    "item_words": np.int32(len(words))})


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_slots(batch["gram"].to_numpy(np.int64))] = True
    yield pd.DataFrame({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for batch in batches:
        for x in batch["bits"]:
            bits |= np.frombuffer(zlib.decompress(x), np.uint8)
    yield pd.DataFrame({"bits": [zlib.compress(bits.tobytes(), 1)]})


def _hits(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            out = []
            for doc, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                grams = ngram_hashes(words_of(text))
                slots = _slots(grams)
                at = np.flatnonzero(bits[slots >> 3] & (128 >> (slots & 7)).astype(np.uint8))
                if len(at):
                    out.append(pd.DataFrame({"gram": grams[at], "doc_id": doc, "text_hash": text_hash, "pos": at.astype(np.int32)}))
            if out:
                yield pd.concat(out)
    return run


def align(passage: list[bytes], item: list[bytes]) -> tuple[float, int, int, int]:
    """Smith-Waterman: (score over a full match, first word, words spanned, words matched).

    A row of the table at a time, in halves of a point; where a cell's path began and how many
    words it matched travel with it.
    """
    names = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([names.get(w, -1) for w in passage], np.int64)
    n = len(a) + 1
    here = np.arange(n)
    gap, mismatch = round(2 * GAP), round(2 * MISMATCH)
    score, begin, matched = np.zeros(n, np.int64), here.copy(), np.zeros(n, np.int64)
    best, found = 0, (0, 0, 0)
    for w in item:
        same = a == names[w]
        # one word of each, or a word of the item left out
        row, row_begin, row_matched = score - gap, begin.copy(), matched.copy()
        step = score[:-1] + np.where(same, 2, -mismatch)
        both = step >= row[1:]
        row[1:] = np.where(both, step, row[1:])
        row_begin[1:] = np.where(both, begin[:-1], row_begin[1:])
        row_matched[1:] = np.where(both, matched[:-1] + same, row_matched[1:])
        new = row <= 0
        row[new], row_begin[new], row_matched[new] = 0, here[new], 0
        # or words of the passage left out, as many as it takes
        reach = row + gap * here
        most = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == most, here, 0))
        score, begin, matched = most - gap * here, row_begin[source], row_matched[source]
        top = int(np.argmax(score))
        if score[top] > best:
            best, found = int(score[top]), (int(begin[top]), top - int(begin[top]), int(matched[top]))
    return best / 2 / len(item), *found


def windows(places: list[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
    """Word ranges that hold every alignment through the seeds: one that scores half of a
    full match has at most ``n`` gaps."""
    start = end = None
    for lo, hi in sorted(places):
        a, b = max(0, lo - n), hi + 2 * n
        if start is not None and a <= end and max(end, b) - start <= max(WINDOW, end - start):
            end = max(end, b)
            continue
        if start is not None:
            yield start, end
        start, end = a, b
    if start is not None:
        yield start, end


def _passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of each candidate, cut out of their document."""
    for batch in batches:
        out = []
        for row, doc, text_hash, text, found in zip(*(batch[c] for c in ["row", "doc_id", "text_hash", "text", "found"])):
            words = words_of(text)
            for c in found:
                for lo, hi in windows([(p["lo"], p["hi"]) for p in c["places"]], c["item_words"]):
                    out.append((row, doc, text_hash, c["item_key"], lo, b" ".join(words[lo:hi])))
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=PASSAGE)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=PASSAGE)


PASSAGE = ["row", "doc_id", "text_hash", "item_key", "lo", "passage"]
PLACE = "row long, doc_id string, text_hash bigint, item_key string"


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out, items = [], {}
        for row, doc, text_hash, key, lo, passage, text in zip(*(batch[c] for c in [*PASSAGE, "item_text"])):
            if key not in items:
                item = words_of(text)
                items[key] = item, Counter(item)
            item, wanted = items[key]
            passage = passage.split()
            # no alignment matches more words than the two have in common
            common = Counter(w for w in passage if w in wanted)
            if sum((common & wanted).values()) < max(MIN_MATCHES, MIN_SCORE * len(item)):
                continue
            score, first, span, matched = align(passage, item)
            if score >= MIN_SCORE and matched >= MIN_MATCHES:
                out.append((row, doc, text_hash, key, score, lo + first, span, matched))
        if out:
            yield pd.DataFrame(out, columns=[*PASSAGE[:4], "score", "first_word", "span_words", "matched_words"])


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, score (0 to 1),
    first_word, span_words and matched_words of the best alignment; text_hash tells rows
    of one id apart. Item ids of equal texts all come out."""
    spark = docs.sparkSession
    small_batches(spark)
    every = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(
        "text is not null").distinct()
    texts = pinned(every.select("text").distinct().withColumn("item_key", F.sha2("text", 256)), "items")
    grams = pinned(texts.mapInPandas(_item_grams, "gram bigint, item_key string, at int, item_words int"), "item-grams")
    bits = grams.select("gram").mapInPandas(_filters, "bits binary").repartition(1).mapInPandas(_merge, "bits binary").first()
    shared = spark.sparkContext.broadcast(zlib.decompress(bits[0]) if bits else bytes(1 << FILTER_BITS - 3))

    # ids travel as text: pandas would round large integers next to nulls
    rows = docs.select(F.col(doc_id).cast("bigint").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    hits = pinned(rows.mapInPandas(_hits(shared), "gram bigint, doc_id string, text_hash bigint, pos int"), "hits")

    # the filter lets a few others pass; the join with the items drops them. An n-gram that an
    # item repeats stands for all its places
    places = grams.groupBy("gram", "item_key").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.first("item_words").alias("item_words"))
    held = places.groupBy("gram").agg(F.count("*").alias("items"))
    texts_with = hits.select("gram", "text_hash").distinct().groupBy("gram").agg(F.count("*").alias("texts"))
    common = held.join(texts_with, "gram").withColumn("rare", F.col("texts") <= FEW_TEXTS).where(
        (F.col("items") <= FEW_ITEMS) | F.col("rare")).select("gram", "rare")
    seeds = measured(places.join(common, "gram"))
    cell = F.floor((F.col("pos") - F.col("first_at")) / DIAGONALS)
    found = hits.join(seeds, "gram").groupBy("doc_id", "text_hash", "item_key", cell.alias("cell")).agg(
        F.min(F.col("pos") - F.col("last_at")).alias("lo"), F.max(F.col("pos") - F.col("first_at")).alias("hi"),
        F.max("rare").alias("rare"), F.min("first_at").alias("low"), F.max("first_at").alias("high"), F.first("item_words").alias("item_words"))
    found = found.groupBy("doc_id", "text_hash", "item_key").agg(
        F.collect_list(F.struct("lo", "hi")).alias("places"), F.max("rare").alias("rare"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.first("item_words").alias("item_words")).where("rare or low < high")
    # all candidates of one document: as many as its own text holds
    per_doc = measured(found.groupBy("doc_id", "text_hash").agg(F.collect_list(
        F.struct("item_key", "item_words", "places")).alias("found")).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found"))
    holders = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["d"]) & (rows["text_hash"] == per_doc["h"]))
    # repeated rows are told apart, as each counts
    passages = holders.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "text", "found").mapInPandas(
        _passages, f"{PLACE}, lo long, passage binary")
    # else each task would hold two Python workers, and all later steps share them out
    passages = pinned(passages, "passages")
    named = measured(texts.select(F.col("item_key").alias("k"), F.col("text").alias("item_text")))
    aligned = passages.join(named, passages["item_key"] == named["k"]).drop("k").mapInPandas(
        _align, f"{PLACE}, score double, first_word long, span_words long, matched_words long")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "span_words", "matched_words"))
    aligned = aligned.groupBy(*PASSAGE[:4]).agg(best.alias("b")).select(
        "doc_id", "text_hash", "item_key", "b.score", (-F.col("b.back")).alias("first_word"), "b.span_words", "b.matched_words")
    ids = every.select("item_id", F.sha2("text", 256).alias("k"))
    return aligned.join(ids, aligned["item_key"] == ids["k"]).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "item_id", "score", "first_word", "span_words", "matched_words", "text_hash")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item."""
    lost = leaks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items)
    lost = measured(lost.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    d = F.col("d")
    return nested(docs).join(
        lost, d[doc_id].cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(d[text].cast("string")) == F.col("__hash")),
        "left_anti").select("d.*")
