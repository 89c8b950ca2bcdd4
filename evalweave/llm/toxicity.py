"""Toxicity scores from a counterfactually regularised classifier.

Features of a text are the distinct words and word beginnings (four and five letters) in
it, as 64-bit hashes. A logistic model is fitted on a bounded sample of labelled rows.
For every sampled text that names a group, the same text with the term swapped for
another of its list (neutral words are on each list) is scored too, and the squared
change of score is part of the loss: naming a group, by itself, must not move a score.

Nulls: null and empty texts get the score of a text without features; null ids are
scored, and are never learned from. Labels without a document, or null, are ignored; of
repeated labels the largest counts; of the texts of a repeated id the one with the smallest hash is
learned from. Features that tell equally much are taken by their hash. Without labels of both kinds all texts score alike.
An empty table gives an empty result. Very long texts are sets of words, as large as their
vocabulary. Only the named columns are read, so that others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import pinned, small_batches

#: Bound of the training sample, for each label; the rows with the smallest hashes of their ids.
SAMPLE = 12_000
#: Most telling features that enter the fit.
FEATURES = 4096
PREDICT_AT = 0.7
STEPS, RIDGE, COUNTERFACTUAL = 600, 1e-5, 1.0
REMEMBERED = 1 << 19
#: Lists of interchangeable group terms; the first of each is neutral.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("human", "black", "white", "asian", "african", "european", "american", "hispanic", "latino", "native"),
    ("someone", "gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("residents", "immigrants", "refugees", "foreigners", "migrants"),
    ("adults", "old", "young", "elderly", "disabled", "deaf", "blind"),
    ("leute", "frauen", "männer", "juden", "christen", "muslime", "ausländer"),
    ("gens", "femmes", "hommes", "juifs", "chrétiens", "musulmans", "étrangers"),
    ("gente", "mujeres", "hombres", "judíos", "cristianos", "musulmanes", "extranjeros"),
)
WORD = regex.compile(r"\w+")


def word_features(word: str) -> list[int]:
    w = word.lower()
    keys = ["w" + w, *("p" + w[:k] for k in (4, 5) if len(w) > k)]
    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall(text)) if text else set()


def swapped(words: set[str], groups: Sequence[Sequence[str]]) -> list[set[str]]:
    """For each list a text draws on, its words with those terms swapped for the neutral one,
    and for the next of the list."""
    low, out = {w.lower() for w in words}, []
    for group in groups:
        if named := low & set(group[1:]):
            k = min(group.index(w) for w in named)
            rest = {w for w in words if w.lower() not in named}
            out += [rest | {group[0]}, rest | {group[k % (len(group) - 1) + 1]}]
    return out


def features(words: set[str]) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int64))


def _features(groups: Sequence[Sequence[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_in(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "features": [features(w).tobytes() for w in words],
                                "swaps": [[features(s).tobytes() for s in swapped(w, groups)] for w in words]})
    return run


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many rows, and how many toxic ones, hold each feature, added up batch by batch."""
    for batch in batches:
        rows = [np.frombuffer(x, np.int64) for x in batch["features"]]
        if rows:
            every, place = np.unique(np.concatenate(rows), return_inverse=True)
            toxic = np.bincount(place, np.repeat(batch["toxic"].to_numpy(float), [len(r) for r in rows]), len(every))
            yield pd.DataFrame({"feature": every, "seen": np.bincount(place, minlength=len(every)), "toxic": toxic.astype(np.int64)})


def _among(features: bytes, chosen: np.ndarray) -> np.ndarray:
    """Places of those that are chosen."""
    found = np.frombuffer(features, np.int64)
    at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
    return at[chosen[at] == found].astype(np.uint16)


def _places(chosen: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [_among(x, chosen) for x in batch["features"]]
            other = [[_among(s, chosen) for s in some] for some in batch["swaps"]]
            yield pd.DataFrame({
                "toxic": batch["toxic"], "places": [x.tobytes() for x in own],
                "gained": [[np.setdiff1d(s, x).tobytes() for s in some] for x, some in zip(own, other)],
                "lost": [[np.setdiff1d(x, s).tobytes() for s in some] for x, some in zip(own, other)]})
    return run


class Sparse:
    """Rows of feature places, for products with a weight vector; each place counts ``values``."""

    def __init__(self, rows: list[np.ndarray], width: int, values: np.ndarray | None = None):
        self.at = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
        self.values, self.shape = np.ones(len(self.at)) if values is None else values, (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at] * self.values, self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.row] * self.values, self.shape[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, float]:
    """(weight of each of ``width`` features, bias). ``rows``: the features of each text, by
    place; ``changes``: those that a swapped term adds to one and those that it removes."""
    positive = int(labels.sum())
    x = Sparse(rows, width)
    sizes = np.array([n for a, b in changes for n in (len(a), len(b))], np.int64)
    change = Sparse([np.concatenate(c) for c in changes], width, np.repeat(np.tile([1.0, -1.0], len(changes)), sizes))
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive))
    # gradient descent with momentum; the step is what the largest curvature allows
    w, b, v = np.zeros(width), 0.0, np.ones(width)
    for _ in range(20):
        v = x.back(weight * x.dot(v / np.linalg.norm(v)))
    step = 1.0 / (0.25 * np.linalg.norm(v) + 0.5 + RIDGE + (4 * COUNTERFACTUAL if changes else 0))
    old_w, old_b = w, b
    for t in range(STEPS):
        m = t / (t + 3)
        at_w, at_b = w + m * (w - old_w), b + m * (b - old_b)
        z = x.dot(at_w) + at_b
        r = weight * (1 / (1 + np.exp(-z)) - labels)
        grad = x.back(r) + RIDGE * at_w
        if changes:
            grad += change.back(change.dot(at_w) * (2 * COUNTERFACTUAL / len(changes)))
        old_w, old_b = w, b
        w, b = at_w - step * grad, at_b - step * r.sum()
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, groups: Sequence[Sequence[str]] = GROUPS) -> tuple[dict[int, float], float]:
    """Fit on labelled rows outside the held-out third. ``docs``: doc_id, text.

    Features are counted where the texts are; the driver holds the places of the chosen few
    in each sampled text, and what swaps change of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for label in (0, 1):
        some = named.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    # at most two samples of ids: the bound of the broadcast. Of a repeated id one text counts
    texts = docs.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = pinned(texts.select("toxic", "text").mapInPandas(_features(groups), "toxic int, features binary, swaps array<binary>"), "labelled")
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < total:
        rate = (positive + 1) / (total + 2)
        return {}, float(np.log(rate / (1 - rate)))
    counted = rows.select("toxic", "features").mapInPandas(_counts, "feature bigint, seen bigint, toxic bigint")
    counted = counted.groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    # chi-square against chance; features seen once or twice tell nothing
    expected = F.col("seen") * F.lit(positive / total)
    gain = (F.col("toxic") - expected) * (F.col("toxic") - expected) / expected
    best = counted.where("seen >= 3").withColumn("gain", gain).where("gain > 8").orderBy(F.desc("gain"), "feature").limit(FEATURES)
    chosen = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], np.int64))
    if not len(chosen):
        return {}, float(np.log(positive / (total - positive)))
    kept = rows.mapInPandas(_places(chosen), "toxic int, places binary, gained array<binary>, lost array<binary>").collect()
    read = lambda x: np.frombuffer(x, np.uint16)
    weights, bias = fit([read(r["places"]) for r in kept], np.array([r["toxic"] for r in kept], float),
                        [(read(g), read(x)) for r in kept for g, x in zip(r["gained"], r["lost"])], len(chosen))
    return dict(zip(chosen.tolist(), weights.tolist())), bias


def _score(weights: dict[int, float], bias: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                hits: set[int] = set()
                for word in words_in(text):
                    found = known.get(word)
                    if found is None:
                        found = tuple(f for f in word_features(word) if f in weights)
                        if len(known) > REMEMBERED:
                            known.clear()
                        if len(word) <= 64:
                            known[word] = found
                    hits.update(found)
                out.append(bias + sum(weights[f] for f in sorted(hits)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(out, -60, 60)))})
    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, groups: Sequence[Sequence[str]] = GROUPS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    weights, bias = train(rows, labels, sample, groups)
    scored = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_score(weights, bias), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
