"""Ranked lexical search: term at a time, with a limit on accumulators.

The corpus is cut into shards of some thousand documents. A shard holds inverted lists of
the terms that the items use: which documents hold a term, and how often. Each shard ranks
its own documents for every item:

1. Terms are taken rarest first. A term adds its share to the score of each document in its
   list; a document without a score yet gets one: an accumulator.
2. What the terms still to come can add at most is known from their lists. Once that is less
   than the k-th best partial score, no new document can reach the first k, so no more
   accumulators are made, and those that can't reach it either are dropped.
3. The other terms update the survivors only, and exactly.

A shard starts from the k-th best score of the shards its task ranked before. What is
left, k rows an item and task at most, is merged by rank. Weights need the document counts
of terms, so the shards are written once, counted, and read again.

Items are taken in blocks of about ``BLOCK_TERMS`` distinct terms of an item, each held by
the driver and sent to the tasks; the corpus is read once a block.

Nulls: a null text has no terms, and is neither counted nor found; null ids are carried, and
come last among equal scores. Empty texts the same. An item without terms has no ranking. Very
long texts are cut into words piece by piece. Repeated documents count each. Repeated items of
one id and text count once; an id with several texts has a ranking for each, told apart by
``text_hash``. Empty tables give an empty result. Only the named columns are read, so that
others can't clash.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import pinned, ranked, small_batches

TOP = 20
#: Distinct terms of items in a block, about; one item may exceed it.
BLOCK_TERMS = 1 << 20
#: A shard ends at so many documents or list entries.
SHARD_DOCS, SHARD_ENTRIES = 4096, 1 << 18
#: Very long texts are cut into words in pieces of so many bytes.
PIECE = 1 << 20
#: A-Z become a-z; ASCII that is neither letter nor digit separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SHARD = ("n_docs bigint, n_terms bigint, terms array<int>, holders array<bigint>, ids binary, known binary, lengths binary, "
         "docs binary, counts binary")
FOUND = "item_key string, doc_id bigint, score bigint"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some at a time."""
    text, lo = text.translate(FOLD), 0
    while lo < len(text):
        hi = len(text) if len(text) - lo <= PIECE else text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for words in pieces(text or b""):
        counts.update(words)
    return counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("item_key"), batch.column("text").cast(pa.binary())):
            counts = term_counts(text.as_py())
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(counts), pa.string()), pa.array(list(counts), pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], ["item_key", "term", "times"])


class Shard:
    """Inverted lists of some documents."""

    def __init__(self):
        self.ids, self.lengths, self.terms, self.docs, self.counts = [], [], array("i"), array("i"), array("q")

    def add(self, doc_id: int | None, n_terms: int, terms: list[int], counts: list[int]) -> None:
        self.docs.extend([len(self.ids)] * len(terms))
        self.terms.extend(terms)
        self.counts.extend(counts)
        self.ids.append(doc_id)
        self.lengths.append(n_terms)

    def packed(self) -> pa.RecordBatch:
        terms, docs, counts = (np.frombuffer(x, x.typecode) for x in (self.terms, self.docs, self.counts))
        order = np.argsort(terms, kind="stable")  # documents stay in order within a term
        names, holders = np.unique(terms, return_counts=True)
        row = [len(self.ids), sum(self.lengths), names.tolist(), holders.tolist(),
               np.array([d or 0 for d in self.ids], np.int64).tobytes(),
               np.array([d is not None for d in self.ids], np.uint8).tobytes(), np.array(self.lengths, np.int64).tobytes(),
               docs[order].tobytes(), counts[order].tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 5]
        names = ["n_docs", "n_terms", "terms", "holders", "ids", "known", "lengths", "docs", "counts"]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)


def _shards(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shard = shared.value, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                held = counts.keys() & vocabulary.keys()
                shard.add(doc_id, counts.total(), [vocabulary[w] for w in held], [counts[w] for w in held])
                if len(shard.ids) >= SHARD_DOCS or len(shard.docs) >= SHARD_ENTRIES:
                    yield shard.packed()
                    shard = Shard()
        if shard.ids:
            yield shard.packed()
    return run


def lengths_to_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """75 plus a quarter of each length over the mean length, in whole hundredths."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 62:
        return 75 + 25 * lengths * n_docs // n_terms
    return np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


def kth_best(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0


def rank_shard(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that may be among the first ``top``, of (documents, shares) lists
    in the order to take them; all of at least the top-th best score are there. ``floor`` is a
    score that ``top`` documents elsewhere reach."""
    most = np.array([s.max(initial=0) for _, s in lists], np.int64)
    rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the terms from here on can add
    scores, left = np.zeros(n_docs, np.int64), len(lists)
    for k, (docs, shares) in enumerate(lists):
        if rest[k] < floor:
            left = k
            break
        scores[docs] += shares
        if rest[k + 1] < scores[docs].max(initial=0) or rest[k + 1] < floor:
            floor = max(floor, kth_best(scores, top))
    alive = np.flatnonzero((scores > 0) & (scores + rest[left] >= floor))
    place = np.full(n_docs, -1, np.int64)
    place[alive] = np.arange(len(alive))
    scores = scores[alive]
    for docs, shares in lists[left:]:
        at = place[docs]
        scores[at[at >= 0]] += shares[at >= 0]
    return alive, scores


def _search(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms = shared.value
        best: dict[str, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                # one shard at a time, and its numbers where they lie
                cell = {name: batch.column(name)[k] for name in batch.schema.names}
                known = np.frombuffer(cell["known"].as_buffer(), np.uint8) > 0
                docs = np.frombuffer(cell["docs"].as_buffer(), np.int32)
                ids, lengths, counts = (np.frombuffer(cell[x].as_buffer(), np.int64) for x in ("ids", "lengths", "counts"))
                norms = lengths_to_norms(lengths, n_docs, n_terms)
                shares = 1_000_000_000 * counts // (1000 * counts + 12 * norms[docs])
                ends = np.cumsum(np.asarray(cell["holders"].values)).tolist()
                spans = dict(zip(cell["terms"].values.to_pylist(), zip([0, *ends], ends)))
                for key, terms in items.items():
                    lists = []
                    for term, weight in terms:
                        if term in spans:
                            lo, hi = spans[term]
                            lists.append((docs[lo:hi], weight * shares[lo:hi]))
                    if not lists:
                        continue
                    before = best.get(key)
                    floor = int(before[0][-1]) if before and len(before[0]) == top else 0
                    found, scores = rank_shard(lists, len(ids), top, floor)
                    if before:
                        scores = np.concatenate([before[0], scores])
                        names, real = np.concatenate([before[1], ids[found]]), np.concatenate([before[2], known[found]])
                    else:
                        names, real = ids[found], known[found]
                    order = np.lexsort((names, ~real, -scores))[:top]
                    best[key] = scores[order], names[order], real[order]
        for key, (scores, names, real) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(scores), pa.string()), pa.array(names, pa.int64(), mask=~real), pa.array(scores, pa.int64())],
                ["item_key", "doc_id", "score"])
    return run


def _block(rows: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    spark = rows.sparkSession
    held: dict[str, list[tuple[bytes, int]]] = {}
    for key, term, times in terms.collect():
        held.setdefault(key, []).append((bytes(term), times))
    vocabulary = {w: k for k, w in enumerate(sorted({w for x in held.values() for w, _ in x}))}
    shards = pinned(rows.mapInArrow(_shards(spark.sparkContext.broadcast(vocabulary)), SHARD), "shards")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # as many rows as the block has terms
    holders = dict(shards.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).groupBy("x.terms").agg(
        F.sum("x.holders")).collect())
    weight = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1)))) for t, n in holders.items()}
    items = {}
    for key, words in held.items():
        known = [(vocabulary[w], times) for w, times in words if vocabulary[w] in weight]
        known.sort(key=lambda x: (holders[x[0]], x[0]))
        items[key] = [(t, times * weight[t]) for t, times in known]
    return shards.mapInArrow(_search(spark.sparkContext.broadcast((items, n_docs, n_terms)), top), FOUND)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score and text_hash (of the item): the ``top`` documents with the
    highest scores above 0 for each item, equal scores by ascending doc_id."""
    small_batches(docs.sparkSession)
    every = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(
        "text is not null").withColumn("item_key", F.sha2(F.col("text").cast("binary"), 256))
    terms = pinned(every.select("item_key", "text").distinct().mapInArrow(
        _item_terms, "item_key string, term binary, times bigint"), "item-terms")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for k in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == k)
        some = _block(rows, mine, top)
        some = some if blocks == 1 else pinned(some, "found")
        found = some if found is None else found.unionByName(some)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = ranked(found, ["item_key"], order, "doc_id", top)
    ids = every.select("item_id", F.col("item_key").alias("text_hash")).distinct()
    return best.join(ids, best["item_key"] == ids["text_hash"]).select("item_id", "rank", "doc_id", "score", "text_hash")
