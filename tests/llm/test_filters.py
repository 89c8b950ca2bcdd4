"""Quality rules, line deduplication, near copies, decontamination."""

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalweave.llm import components, decontam, linededup, nearjoin, quality
from tests.llm.helpers import (
    CLASHING, SCHEMA, ascii_low, awkward, awkward_rows, blank_words, brute_components, clashing, empty, folder_of)


def order(rows):
    return sorted(rows, key=repr)


def brute_metrics(text):
    w = blank_words(text)
    lines = [x for x in (text or "").split("\n") if blank_words(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_metrics(spark):
    got = [tuple(r) for r in quality.assess(awkward(spark)).select("doc_id", *quality.METRICS).collect()]
    assert order(got) == order([(r[0], *brute_metrics(r[1])) for r in awkward_rows()])


def test_quality_metrics_of_repeats(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choice("abc") for _ in range(random.randint(0, 40))), "en", "s", 0) for k in range(80)]
    got = quality.assess(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *quality.METRICS).collect()
    assert order(map(tuple, got)) == order([(r[0], *brute_metrics(r[1])) for r in rows])


def test_quality_host_verdicts(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good, "en", f"good{k % 8}", 0) for k in range(400)]
    rows += [(1000 + k, good if k % 20 == 0 else "too short", "en", "bad", 0) for k in range(200)]
    rows += [(2000, "too short", "en", "tiny", 0), (2001, good, "en", "tiny", 0), (2002, good, "en", None, 0)]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] for k in range(400)) and not any(got[1000 + k] for k in range(200))
    # one failure of two is no verdict on a host
    assert not got[2000] and got[2001] and got[2002]


def test_quality_keeps_columns(spark):
    docs = clashing(spark)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None, 2**53 + 1, 9} - {9}
    assert quality.keep(empty(spark)).count() == quality.assess(empty(spark)).count() == 0


def brute_lines(rows):
    first = {}
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = ascii_low(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
            if len(key) >= 10 and d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        key = lambda x: ascii_low(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
        kept = [x for x in lines if len(key(x)) < 10 or first.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(awkward_rows())]
    got = linededup.digest(awkward(spark)).drop("keep").collect()
    assert order(map(tuple, got)) == order(want)


def test_line_dedup_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_SHARE", 0.05)
    rows = [(k, f"a line that all share\nline number {k % 40} of few\nown {k} {'x' * (k % 13)}", "en", "s", 0) for k in range(300)]
    rows += [(500, "a line that all share", "en", "s", 0), (None, "a line that all share\nshort", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert linededup._hot_hashes(linededup.line_keys(docs))
    got = linededup.digest(docs).drop("keep").collect()
    assert order(map(tuple, got)) == order([(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines(rows)])


def test_line_dedup_applies(spark):
    docs = clashing(spark)
    out = linededup.apply(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[11] == "other text 2" and texts[4] is None and texts[2] == "" and texts[1]
    assert linededup.apply(empty(spark)).count() == 0 and linededup.keep_bitmaps(empty(spark)).count() == 0
    runs = linededup.keep_bitmaps(docs).where("doc_id = 11").first()
    assert [tuple(r) for r in runs["keep"]] == [(1, 1)] and runs["n_lines"] == 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 100), (95, 90), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in (90, 95, 100)} == {90}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def random_family(n, words, edits, seed):
    random.seed(seed)
    base = [f"v{random.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(random.randint(0, edits)):
            w[random.randrange(words)] = f"e{random.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_join(spark, k, percent):
    rows = [(i, t) for i, t in enumerate(random_family(25, 120, 4, 1) + random_family(12, 30, 2, 2) + random_family(6, 2, 1, 3))]
    rows += [(d, t) for d, t, *_ in [(100 + (r[0] or 0) if r[0] is not None else None, r[1]) for r in awkward_rows()]]
    got = nearjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string"), words=k, percent=percent)
    assert order(tuple(r)[:3] for r in got.collect()) == order(brute_components(rows, k, percent))


def test_near_join_dense(spark, monkeypatch):
    # all tokens count as frequent from 4 documents on, and groups overflow at 4
    monkeypatch.setattr(nearjoin, "DENSE", 4)
    monkeypatch.setattr(nearjoin, "BLOCK_TOKENS", 500)
    rows = [(i, t) for i, t in enumerate(random_family(40, 60, 5, 5) + random_family(20, 40, 3, 6))]
    batches = lambda f: list(f)
    import pandas as pd
    # the worker reads the module's own constants, so this part runs here
    level, frequency = nearjoin.levels(sketch_of(rows))
    out = []
    for _, t in rows:
        s = nearjoin.shingle_set(t, 3)
        tokens, tier, ell, dense, wanted = nearjoin.prefix(s, level, frequency, 90)
        assert len(tokens) == len(tier) and wanted <= ell and (wanted > 0 or dense.any())
        out.append(pd.DataFrame({"sig": [nearjoin.signature(s)], "tokens": [s.tolist()]}))
    cell = pd.concat(out)
    links = nearjoin._block_links(90)(cell)
    sets = {nearjoin.signature(nearjoin.shingle_set(t, 3)) for _, t in rows}
    parent = {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in zip(links["a"], links["b"]):
        parent[root(a)] = root(b)
    want = brute_components(rows, 3, 90)
    got = {}
    for (d, t) in rows:
        got.setdefault(root(nearjoin.signature(nearjoin.shingle_set(t, 3))), []).append(d)
    assert sorted(min(v) for v in got.values()) == sorted({w[2] for w in want})


def sketch_of(rows):
    import numpy as np
    sketch = np.zeros(1 << nearjoin.SKETCH_BITS, np.uint32)
    for _, t in rows:
        nearjoin._add(sketch, nearjoin._bins(nearjoin.shingle_set(t, 3)))
    return sketch


def test_near_family_of_many(spark):
    """A family over DENSE, so that its tokens are frequent and make clusters."""
    rows = [(i, t) for i, t in enumerate(random_family(200, 40, 6, 9))]
    got = nearjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert order(tuple(r)[:3] for r in got.collect()) == order(brute_components(rows, 3, 90))


def test_near_pair_that_shares_rare_tokens_only(spark):
    """Two documents whose dense prefix tokens could make up all matches, but differ: they
    share rare prefix tokens and, past the prefix, a passage of yet more documents."""
    passage = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rare, x, y, z = passage("r", 36), passage("x", 16), passage("y", 16), passage("z", 352)
    rows = [(0, f"{rare} {x} {z}"), (1, f"{rare} {y} {z}")]
    rows += [(1000 + k, f"{p} {passage(f'own{k}p', 30)}") for k, p in enumerate([x, y] * 200)]
    rows += [(2000 + k, f"{z} {passage(f'own{k}z', 100)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    level, frequency = nearjoin.levels(sketch_of(rows))
    for _, t in rows[:2]:
        assert nearjoin.prefix(nearjoin.shingle_set(t, 3), level, frequency, 90)[4] == 0
    got = [tuple(r)[:3] for r in nearjoin.join(docs).collect()]
    assert (1, 384 + 18, 0) in got and order(got) == order(brute_components(rows, 3, 90))


def test_sketches_are_summed_a_piece_at_a_time():
    parts = np.random.default_rng(1).integers(0, 9, (3, 1 << nearjoin.SKETCH_BITS), np.uint32)
    parts[:2, 5], parts[:2, -1] = 2**32 - 1, 2**31  # beyond what a count holds
    packed = [pd.DataFrame({"sketch": [zlib.compress(p.tobytes(), 1)]}) for p in parts]
    want = np.minimum(parts.sum(axis=0, dtype=np.uint64), 2**32 - 1)
    tracemalloc.start()
    got = next(nearjoin._sum_sketches(iter(packed)))["sketch"][0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.frombuffer(zlib.decompress(got), np.uint32) == want).all()
    assert peak < 2.5 * want.nbytes / 2  # the sum of 4 bytes a count, and what is sent


def test_near_stage(spark):
    docs = clashing(spark)
    out = nearjoin.first_of_group(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and None not in ids and 2 not in ids and 3 not in ids and 7 in ids and 8 not in ids and ids.count(9) == 1
    assert {4, 5, 6, 10, 11, 12, 2**53 + 1} <= set(ids)  # without words, or alone
    assert nearjoin.join(empty(spark)).count() == nearjoin.first_of_group(empty(spark)).count() == 0


def test_near_stage_keeps_one_row_of_a_group(spark):
    """Repeated ids, null ids, one id with several texts: one row of each component."""
    text, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(7, text, f"x{k}") for k in range(5)] + [(None, text, "n")] * 3 + [(8, text, "y")]
    rows += [(None, other, "a"), (None, other, "b"), (20, "", "e"), (20, "", "e"), (None, None, "z"), (7, " ".join(f"u{k}" for k in range(60)), "own")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, note string").repartition(parts)
        got = [tuple(r) for r in nearjoin.first_of_group(docs).collect()]
        assert sum(r[1] == text for r in got) == 1 and next(r[0] for r in got if r[1] == text) == 7
        assert sum(r[1] == other for r in got) == 1 and len(got) == 6
        assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, nearjoin.first_of_group(docs.repartition(3)).collect())))


def test_leaks(spark):
    random.seed(7)
    noise = lambda n: [f"n{random.randrange(5000)}" for _ in range(n)]
    items = [(k, " ".join(noise(30))) for k in range(20)] + [(50, None), (51, "too short"), (52, "")]
    first = items[0][1].split()
    edited = [w if k % 9 else "edit" for k, w in enumerate(first)]
    fewer = [w for k, w in enumerate(first) if k % 10 != 5]
    docs = [(1, " ".join(noise(300)) + ". " + items[3][1].upper() + "! " + " ".join(noise(50))), (2, " ".join(noise(40) + edited + noise(40))),
            (3, " ".join(noise(400))), (4, " ".join(fewer)), (None, items[5][1]), (5, None), (6, ""), (7, items[4][1]), (7, items[4][1]),
            (8, " ".join(noise(20) + first[:6] + noise(20)))] + [(100 + k, items[9][1]) for k in range(50)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, i).collect()]
    want = [(1, 3), (2, 0), (4, 0), (None, 5), (7, 4), (7, 4)] + [(100 + k, 9) for k in range(50)]
    assert order(got) == order(want)
    assert {r["doc_id"] for r in decontam.clean(d, i).collect()} == {3, 5, 6, 8}
    assert decontam.leaks(d, i.limit(0)).count() == decontam.leaks(d.limit(0), i).count() == 0
    docs = clashing(spark)
    assert decontam.clean(docs, i).columns == docs.columns


def test_no_task_of_leaks_holds_two_python_workers(spark):
    items = spark.createDataFrame([(1, " ".join(f"i{k}" for k in range(30)))], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"see {' '.join(f'i{j}' for j in range(30))} there {k}") for k in range(9)], "doc_id bigint, text string")
    found = decontam.leaks(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 9 and plan.count("MapInPandas") == 1


def test_leaks_of_edited_copies(spark):
    """Exact copies must not displace edited ones: all pairs against alignment of whole texts."""
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(5000)}" for _ in range(n)]
    items = [(k, noise(n)) for k, n in enumerate([6, 18, 18, 36, 36, 90])]
    texts = []
    for _, item in items:
        texts += [item, noise(50) + item + noise(50), item + noise(300) + item]
        texts.append(noise(9) + [w if k % 6 != 5 else "edit" for k, w in enumerate(item)] + noise(9))
        texts.append(noise(9) + [w if k != 2 else "edit" for k, w in enumerate(item)] + noise(9))
        half = len(item) // 2
        texts.append(noise(9) + item[:half] + noise(half) + item[half:] + noise(9))
        for rate in (0.1, 0.2):
            texts += [noise(20) + [w if rng.random() > rate else "edit" for w in item] + noise(20) for _ in range(8)]
        texts.append(item[:3] + noise(40))
    want = []
    for d, words in enumerate(texts):
        for k, item in items:
            found = decontam.align([w.encode() for w in words], [w.encode() for w in item])
            if found[0] >= decontam.MIN_SCORE and found[3] >= decontam.MIN_MATCHES:
                want.append((d, k, *found))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id bigint, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string"))
    assert len(want) > 120 and order(map(tuple, got.drop("text_hash").collect())) == order(want)


def plain_score(a, b):
    """Smith-Waterman cell by cell."""
    table, best = [[0.0] * (len(a) + 1)], 0.0
    for w in b:
        row = [0.0]
        for j, v in enumerate(a, 1):
            row.append(max(0.0, table[-1][j - 1] + (1 if v == w else -0.5), table[-1][j] - 0.5, row[j - 1] - 0.5))
        best = max(best, *row)
        table.append(row)
    return best / len(b)


def test_alignment_cell_by_cell():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 30))] for _ in range(2))
        score, first, span, matched = decontam.align([x.encode() for x in a], [x.encode() for x in b])
        assert score == plain_score(a, b)
        if score:  # the span alone scores as much, and matches as many
            again = decontam.align([x.encode() for x in a[first:first + span]], [x.encode() for x in b])
            assert again[0] == score and again[1] == 0 and again[2] == span and matched <= min(span, len(b))


def test_leaks_against_a_plain_aligner(spark):
    """Recall 1.0 on differently edited copies beside hundreds of exact ones, with a phrase that
    all items and all texts hold."""
    rng = random.Random(12)
    noise = lambda n: [f"n{rng.randrange(4000)}" for _ in range(n)]
    phrase = ["one", "of", "the"]
    items = [noise(12) + phrase + noise(13) for _ in range(12)]
    texts = [noise(20) + phrase + noise(30) for _ in range(200)] + [list(items[0]) for _ in range(90)]
    for item in items:
        for rate in (0.08, 0.15, 0.2):
            for _ in range(4):
                edited = [w if rng.random() > rate else rng.choice(["edit", ""]) for w in item]
                texts.append(noise(9) + [w for w in edited if w] + noise(9))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(
        docs, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")).collect()}
    for d, words in enumerate(texts):
        for k, item in enumerate(items):
            if len(set(words) & set(item)) < 5:
                continue
            score = plain_score(words, item)
            assert ((d, k) in got) == (score >= 0.5), (words, item, score)
            assert score < 0.5 or abs(got.pop((d, k)) - score) < 1e-9
    assert not got


def test_a_common_phrase_joins_nothing(spark):
    """Two thousand texts and items share one phrase, and no text leaks an item."""
    words = lambda name, k: [f"{name}{k}x{j}" for j in range(15)]
    rows = lambda name: [(k, " ".join(words(name, k) + ["one", "of", "the"] + words(name, k))) for k in range(2000)]
    docs, items = (spark.createDataFrame(rows(x), f"{y} bigint, text string") for x, y in (("d", "doc_id"), ("i", "item_id")))
    began = time.perf_counter()
    assert decontam.leaks(docs, items).count() == 0
    assert time.perf_counter() - began < 60


def test_a_giant_item_is_aligned_in_bounded_memory():
    rng = random.Random(8)
    item = [f"i{rng.randrange(10**6)}".encode() for _ in range(6000)]
    passage = [b"x"] * 500 + item[:3000] + [b"y"] * 40 + item[3000:] + [b"x"] * 500
    tracemalloc.start()
    score, first, span, matched = decontam.align(passage, item)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (score, first, span, matched) == (1 - 20 / 6000, 500, 6040, 6000) and peak < 10 << 20


def test_alignment():
    item = [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert decontam.align([b"x", *item, b"y"], item) == (1.0, 1, 6, 6)
    score, first, span, matched = decontam.align([b"a", b"b", b"q", b"d", b"e", b"f"], item)
    assert (round(score, 6), first, span, matched) == (0.75, 0, 6, 5)
    score, first, span, matched = decontam.align([b"z", b"a", b"b", b"d", b"e", b"f"], item)
    assert (round(score, 6), first, span, matched) == (0.75, 1, 5, 5)


def test_pipeline_on_awkward_documents(spark, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows and clashing columns, end to end."""
    import corpus_pipeline

    rng = random.Random(30)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))
    own = " ".join(f"z{rng.randrange(10**6)}" for _ in range(200))
    rows = awkward_rows() + [(300, f"{own[:700]} {item}", "en", "a", 1), (301, " ".join(f"y{k}" for k in range(30_000)), "en", "a", 1),
                             (None, " ".join(f"g{k}" for k in range(90)), "en", "a", 1), (302, own, "en", "a", 1), (302, own, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    folder = folder_of(tmp_path, documents=docs.withColumns({c: F.lit(c) for c in CLASHING}),
                       benchmark=spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string"))
    got = corpus_pipeline.run(spark, folder).collect()
    # 2 and a row without an id lose their only line to 1 and stay, empty; 3 is a near copy, 300
    # holds the item, 9 repeats itself, 4 to 8 and 10 to 12 are short
    assert {r["doc_id"] for r in got} == {1, 2, 2**53 + 1, 301, 302, None}
    assert {r["doc_id"] for r in got if not r["ids"]} == {2, None}
    assert sum(r["doc_id"] == 302 for r in got) == 1
    none = folder_of(tmp_path / "none", documents=docs.limit(0), benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, none).count() == 0
