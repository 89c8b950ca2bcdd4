"""Periodic runs, ranked search and exact top-k, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalweave.llm import exacttop, lexical, periodic
from evalweave.llm.queries import QUERIES
from tests.llm.helpers import SCHEMA, ascii_low, awkward, awkward_rows, blank_words, clashing, empty, folder_of


def order(rows):
    return sorted(rows, key=repr)


# ---- periodic runs ----

def brute_runs(w):
    """Every period, word by word."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def brute_digest(doc_id, text):
    w = blank_words(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repetitive(seed, n, letters):
    rng = random.Random(seed)
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        s = rng.randrange(n)
        p, e = rng.randint(1, max(1, (n - s) // rng.randint(3, 8))), rng.randint(s, n)
        for i in range(s, e):
            w[i] = w[s + (i - s) % p]
    return [str(x) for x in w]


def test_runs_against_every_period():
    for seed in range(1500):
        rng = random.Random(seed)
        w = repetitive(seed, rng.randint(6, 150), rng.choice([1, 2, 3, 6, 50]))
        assert periodic.find_runs(periodic.word_ids([x.encode() for x in w])) == brute_runs(w), w
    for seed in range(12):
        w = repetitive(seed, 1500 + 100 * seed, [2, 1000][seed % 2])
        assert periodic.find_runs(periodic.word_ids([x.encode() for x in w])) == brute_runs(w)


def test_runs_of_texts_that_repeat_themselves_often():
    a, b = ["0"], ["0", "1"]
    while len(b) < 900:
        a, b = b, b + a
    for w in (b, list("ab" * 300 + "abc" * 200), list("aab" * 90 + "aac" * 90) * 5):
        assert periodic.find_runs(periodic.word_ids([x.encode() for x in w])) == brute_runs(w)


def test_runs_of_a_giant_text_take_linear_time():
    period = [f"w{k}" for k in range(90_001)]
    ids = periodic.word_ids([x.encode() for x in period * 5 + ["end"] * 200_000])
    assert periodic.find_runs(ids) == [(0, 450_005, 90_001), (450_005, 200_000, 1)]


def test_periodic_query(spark, tmp_path):
    rows = [(k, " ".join(repetitive(k, 5 + k, [2, 30][k % 2])), "en", "s", 0) for k in range(220)]
    rows += [(1000 + k, " ".join(f"x{j}" for j in range(40 + k)), "en", "s", 0) for k in range(60)]
    rows += [r for r in awkward_rows() if r[1] is None or len(r[1]) < 5000]
    got = QUERIES["op11_periodic_runs"](spark, folder_of(tmp_path, documents=spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_digest(r[0], r[1]) for r in rows]
    assert order(map(tuple, got.collect())) == order(want)
    assert any(w[4] and w[4] > 8 for w in want if w[0] and w[0] >= 1000)


def test_periodic_edges(spark):
    found = {r["doc_id"]: r for r in periodic.find(clashing(spark)).collect()}
    assert found[4]["runs"] == [] and found[4]["collapsed"] == "" and found[6]["n_words"] == 0
    assert [tuple(r) for r in found[9]["runs"]] == [(0, 24000, 400)] and found[9]["collapsed"].split()[-1] == "w399"
    assert periodic.digest(periodic.find(periodic.planted(empty(spark)))).count() == 0


# ---- ranked search ----

def brute_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", ascii_low(text))


def brute_ranking(docs, items, top=20):
    counts = [(d, Counter(brute_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    holders = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in brute_terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return out


def prose(seed, n, words=400):
    """Words as skewed as in real texts."""
    rng = random.Random(seed)
    return " ".join(f"w{int(words ** rng.random())}" + rng.choice(["", ",", ".", "\n"]) for _ in range(n))


@pytest.mark.parametrize("shard", [8192, 7])
def test_search_query(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    docs = [(k, prose(k % 150, 3 + k % 90)) for k in range(200)] + [(r[0], r[1]) for r in awkward_rows()]
    items = [(k, prose(500 + k, 4 + 5 * k)) for k in range(9)] + [(50, None), (51, ""), (52, "!?"), (53, "w1 W1 w1."), (54, "absent")]
    folder = folder_of(tmp_path, documents=spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                       benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    got = QUERIES["op12_lexical_search"](spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert order(map(tuple, got.collect())) == order(brute_ranking(docs, items))


def test_search_edges(spark):
    docs = clashing(spark)
    items = spark.createDataFrame(
        [(1, "one two"), (1, "one two"), (1, "x"), (None, "one two"), (2, "w1 w2 w250")], "item_id bigint, text string")
    got = lexical.search(docs, items.withColumns({"rank": items["text"], "score": items["text"]}), top=2).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r["item_id"], r["text_hash"]].append((r["rank"], r["doc_id"]))
    key = hashlib.sha256(b"one two").hexdigest()
    assert sorted(seen[1, key]) == sorted(seen[None, key]) == [(1, 7), (2, 8)]
    assert seen[1, hashlib.sha256(b"x").hexdigest()] == [(1, 12)] and len(seen) == 4
    assert lexical.search(empty(spark), items).count() == lexical.search(docs, items.limit(0)).count() == 0


def test_search_in_blocks_of_items(spark):
    docs = [(k, prose(k, 60)) for k in range(80)]
    items = [(k, prose(900 + k, 20)) for k in range(12)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"),
                         spark.createDataFrame(items, "item_id bigint, text string"), block_terms=60)
    assert order(tuple(r)[:4] for r in got.collect()) == order(brute_ranking(docs, items))


def test_a_shard_stops_making_accumulators():
    rng = np.random.default_rng(1)
    rare = (np.arange(40), np.full(40, 10_000))
    common = [(np.arange(5000), rng.integers(1, 60, 5000)) for _ in range(20)]
    alive, scores = lexical.rank_shard([rare, *common], 5000, 20, 0)
    whole = np.zeros(5000, int)
    for d, s in [rare, *common]:
        whole[d] += s
    assert set(alive) <= set(range(40)) and (whole[alive] == scores).all()
    best = np.sort(whole)[-20]
    assert set(np.flatnonzero(whole >= best)) <= set(alive)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = prose(3, 500).encode()
    assert lexical.term_counts(text) == Counter(x.encode() for x in brute_terms(text.decode()))
    assert lexical.term_counts(b"x" * 100) == {b"x" * 100: 1}


# ---- exact top-k ----

def brute_top(rows, top=10, every=100):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for i, q in whole:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for j, c in whole if j != i)
            out += [(i, k + 1, None if none else j, -s) for k, (s, none, j) in enumerate(scored[:top])]
    return out


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    v = centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dims))
    return [(int(k), [float(np.float32(x)) for x in row / np.linalg.norm(row)]) for k, row in enumerate(v)]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_top_k_query(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(exacttop, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(exacttop, "BLOCK_ROWS", 60)
    monkeypatch.setattr(exacttop, "QUERIES", 3)
    monkeypatch.setattr(exacttop, "LANE", 2)
    rows = vectors(900, 20) + [(2000 + k, vectors(1, 20, 7)[0][1]) for k in range(30)]  # thirty equal ones
    rows += [(5001, None), (5002, [1.0, None]), (5003, [float("nan")] * 20), (5004, [float("inf")] * 20), (5100, []), (5005, [0.5] * 3),
             (None, [0.9] * 20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = QUERIES["op13_exact_top_k"](spark, folder_of(tmp_path, embeddings=df))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert order(map(tuple, got.collect())) == order(brute_top([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v])
                                                                for i, v in rows]))


def test_top_k_edges(spark):
    kinds = "vec_id bigint, embedding array<double>, v string, qb string, n string, score string"
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, -1.0]), (None, [5.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], kinds)
    got = exacttop.search(df, top=4).collect()
    assert len({r["query_hash"] for r in got}) == 2  # one id, two vectors; copies of a query ask once
    one = [(r["rank"], r["vec_id"]) for r in got if r["rank"] == 1]
    assert sorted(one, key=repr) == sorted([(1, None), (1, 1)], key=repr)
    assert exacttop.search(df.limit(0)).count() == exacttop.search(df.where("vec_id = 1")).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e7, -3e6]), (1, [1e5, 2e5]), (2, [1e300, 1.0]), (3, [-1e300, 1.0]), (4, [123456.789, 0.001])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in exacttop.search(df).orderBy("rank").collect()]
    q, c1, c4 = ([math.floor(1024 * x) for x in rows[k][1]] for k in (0, 1, 4))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert got == [(2, 2**63 - 1), *sorted([(1, dot(q, c1)), (4, dot(q, c4))], key=lambda x: -x[1]), (3, -2**63)]


def test_bounds_drop_most_candidates():
    rows = vectors(4000, 64, 3)
    ids = np.array([r[0] for r in rows])
    whole = np.array([[math.floor(1024 * x) for x in r[1]] for r in rows], np.int64)
    block = exacttop.Columns({"ids": ids.tobytes(), "known": np.ones(4000, np.uint8).tobytes(), "n": 4000, "dims": 64,
                              "cells": np.ascontiguousarray(whole.T).tobytes()})
    alive, scores = block.best(whole[0], 0, 10, None)
    exact = whole @ whole[0]
    assert (exact[alive] == scores).all() and len(alive) < 400
    assert set(np.argsort(-exact[1:])[:10] + 1) <= set(alive)
