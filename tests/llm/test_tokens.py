"""SentencePiece, toxicity, rollups, sharding, token files, licences, pipeline."""

import random
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import licenses, pieces, rollups, sharding, tokenfile, toxicity
from evalweave.llm.queries import QUERIES, SQL, tokenizer_path
from evalweave.session import scratch_path
from tests.conftest import SMALL
from tests.llm.helpers import awkward, awkward_rows, clashing, empty

MODEL = tokenizer_path("piece_bpe_32k.model")
WORDS = tokenizer_path("word_bpe_49k.json")


def chunked(model, text, size):
    parts = [pieces.Chunk(model, *p) for p in pieces.cut(pieces.stored(text), model.longest, size)]
    matrices = [pieces._to_dict(p.matrix()) for p in parts]
    states = pieces.route(matrices, (0, 0), None)
    return [i for p, a, b in zip(parts, states, states[1:]) for i in p.trace(a, b)]


def odd_texts():
    random.seed(4)
    letters = "abcdeé ▁ñ\n日本\U0001F600 -_.1234  ttthheein"
    return ["".join(random.choice(letters) for _ in range(random.randint(1, 300))) for _ in range(80)] + [
        "the" * 60, "a" * 200, " " * 90, "  a" * 40, "x   " * 30, "<0x41>" * 20]


@pytest.mark.parametrize("size", [17, 64])
def test_chunks_equal_library(size):
    model = pieces.load(MODEL)
    for text in odd_texts():
        assert chunked(model, text, size) == model.library.encode(text)


def test_unigram_scan_is_optimal():
    """The same vocabulary scored as a unigram model: as good a path as the library's."""
    from sentencepiece import sentencepiece_model_pb2
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    spec.trainer_spec.model_type = pieces.UNIGRAM
    model = pieces.Model(proto=spec.SerializeToString())
    worth = lambda ids: sum(model.weight(model.names[i]) for i in ids)
    for text in ["".join(random.Random(k).choice("theinsa r") for _ in range(120)) for k in range(20)]:
        assert worth(chunked(model, text, 17)) == pytest.approx(worth(model.library.encode(text)))


def test_product_is_associative():
    model = pieces.load(MODEL)
    m = [pieces._to_dict(pieces.Chunk(model, *p).matrix()) for p in pieces.cut(pieces.stored("thethere" * 30), model.longest, 40)]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = pieces.product(left, x)
    for x in reversed(m[:-1]):
        right = pieces.product(x, right)
    assert left == right and len(left) >= 1


def test_encode_table(spark):
    library = pieces.load(MODEL).library
    got = {}
    rows = pieces.encode(awkward(spark), MODEL, chunk=2000, group=3)
    for r in sorted(rows.collect(), key=lambda r: (repr(r["doc_id"]), r["chunk"])):
        assert r["round_trip"]
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    for d, text, *_ in awkward_rows():
        want = library.encode(text or "")
        if d == 9:  # twice in the table
            assert sorted(got[9]) == sorted(want * 2)
        else:
            assert got[d] == want
    back = pieces.decode(rows.where("doc_id = 10"), MODEL).first()
    assert back["text"] == awkward_rows()[11][1]
    assert pieces.encode(empty(spark), MODEL).count() == 0 and pieces.encode(clashing(spark), MODEL, chunk=2000).count() == rows.count()


def test_token_files(spark):
    docs = clashing(spark)
    manifest = tokenfile.write(docs, scratch_path(spark, "t"), WORDS)
    rows = tokenfile.read(manifest).orderBy("start").collect()
    from tokenizers import Tokenizer
    direct = Tokenizer.from_file(WORDS)
    want = sorted(((d is not None, d or 0), t or "") for d, t, *_ in awkward_rows())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == [w[0] for w in want]
    start = 0
    by_id = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(ids) and r["crc"] == zlib.crc32(r["ids"])
        start += len(ids)
        by_id[r["doc_id"]] = ids
    for d, t, *_ in awkward_rows():
        assert by_id[d] == direct.encode(t or "", add_special_tokens=False).ids + [2]
    some = tokenfile.read(manifest, [2, 9, 777]).collect()
    assert sorted(r["doc_id"] for r in some) == [2, 9, 9]
    assert tokenfile.read(tokenfile.write(empty(spark), scratch_path(spark, "t"), WORDS)).count() == 0


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer
    direct, encoder = Tokenizer.from_file(WORDS), tokenfile.Encoder(WORDS)
    for text in odd_texts() + ["a\tb c\r\nd", "It's  we'LL x<|endoftext|>y", "é ́a İI ſ ΣΑΣ", " ", ""]:
        assert np.frombuffer(encoder(text), "<u4").tolist() == direct.encode(text, add_special_tokens=False).ids


def test_frames_are_independent_and_checked():
    import io
    import zstandard
    out = io.BytesIO()
    w = tokenfile.Writer(out)
    for k in range(40):
        w.add(k if k else None, np.arange(k * 1000, dtype="<u4").tobytes())
    w.close()
    data = out.getvalue()
    r = tokenfile.Reader(io.BytesIO(data), len(data))
    assert len(r.frames) > 5 and [len(x[2]) // 4000 for x in r.documents()] == list(range(40))
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(x[2] for x in r.documents())
    hurt = bytearray(data)
    hurt[int(r.ends[0]) - 4] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Reader(io.BytesIO(bytes(hurt)), len(hurt)).frame(0)


def test_shards(spark):
    random.seed(2)
    rows = [(k, "t" * random.randint(0, 900) + str(k), random.choice(["en", "de", None]), f"s{k % 5}", 0) for k in range(3000)]
    rows += [(5000 + k, "copy" * 40, "en", f"s{k % 7}", 0) for k in range(1500)] + [(1, "twin", "en", "a", 0)] * 2 + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = sharding.assign(docs).toPandas()
    assert len(out) == len(rows)
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    small = out[out["doc_id"] < 5000].groupby("text_crc32")["shard"].nunique()
    assert small.max() == 1
    assert out.set_index("doc_id").loc[7, "text_crc32"] == zlib.crc32(rows[7][1].encode())
    three = sharding.assign(docs, shards=3).toPandas().groupby("shard")["size"].sum()
    assert len(three) == 3 and three.max() < 1.05 * three.mean()
    assert sharding.assign(empty(spark)).count() == 0 and sharding.assign(clashing(spark)).count() == len(awkward_rows())


def brute_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    at = [(k, label) for p, label in licenses.NOTICES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licences(spark):
    texts = ["Released under THE-MIT.License; under the mit license under the mit license", "under the mit licence", "underthe mit license",
             "Apache License, Version 2", "apache lisense versin 2.0", "cc by nc", "cc by nd", "ccby nc", "xunder the mit license", None, "",
             "é under the MIT license é", "under the mit licenses", "under the mit license " * 500 + "cc by nc apache license version 2",
             "the quick brown fox", "see the mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "cc by nc")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for k, t in [*enumerate(texts), (None, "cc by nc")]:
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_places(t), t
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and 0.9 < got[1]["score"] < 1
    assert got[2]["labels"] == "mit" and got[4]["labels"] == "apache-2" and got[12]["labels"] == "mit"
    assert got[6]["labels"] == "" and got[14]["labels"] == "" and got[14]["score"] == 0 and got[0]["score"] == 1
    assert [(s["first_word"], s["n_words"], s["edits"]) for s in got[11]["spans"]] == [(1, 4, 0)]
    assert licenses.scan(empty(spark)).count() == 0 and licenses.scan(clashing(spark)).count() == len(awkward_rows())


def test_a_long_text_of_notices_takes_linear_time():
    notices = [licenses.Notice(p, x) for p, x in licenses.NOTICES.items()]
    began = time.perf_counter()
    found = licenses.scan_text("under the mit license " * 60_000, notices)
    assert found[:4] == (240_000, 60_000, 0, 239_996) and len(found[7]) == 60_000
    assert time.perf_counter() - began < 30


def test_licence_query_searches_the_asked_phrases(spark, tmp_path):
    """Places counted by hand: the first phrase begins with 'under'."""
    want = {1: ("released under the MIT License ok", 1, 1, 1, "mit", "mit", 1.0), 2: ("see the mit license ok", 0, None, None, "", "", 0.0),
            3: ("the mit license or Under The-MIT license, under the apache license version 2", 2, 4, 10, "apache-2,mit", "apache-2,mit", 1.0),
            4: ("a under teh mit license b", 0, None, None, "", "mit", 1 - 2 / 21), 5: ("licensed under cc by nc 4", 1, 2, 2, "cc-by-nc", "cc-by-nc", 1.0)}
    spark.createDataFrame([(k, v[0]) for k, v in want.items()], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op10_license_scan"](spark, str(tmp_path)).collect():
        got = (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
        assert got == want[r["doc_id"]][1:], r
        assert [s["first_word"] for s in r["spans"]] == {1: [1], 2: [], 3: [4, 10], 4: [1], 5: [2]}[r["doc_id"]]


def test_pigeonhole_finds_all_edits():
    """Every text within the bound, against a plain edit distance over all windows."""
    notice = licenses.Notice("apache license version 2", "x")
    random.seed(5)
    for _ in range(200):
        text = list("apache license version 2")
        for _ in range(2):
            k = random.randrange(1, len(text) - 1)
            kind = random.choice("ids")
            text[k:k + (kind != "i")] = [] if kind == "d" else [random.choice("qz")]
        assert licenses.spans((" ab " + "".join(text) + " cd ").encode(), notice), text


def labelled(spark):
    random.seed(6)
    rows, labels = [], []
    for k in range(600):
        w = [f"w{random.randrange(300)}" for _ in range(40)]
        bad = k % 6 == 0
        if bad:
            w[random.randrange(40)] = random.choice(["vilest", "stupidx", "muckhead"]) + random.choice(["", "s"])
        if k % 4 == 0:
            w[random.randrange(40)] = "women"
        if bad and random.random() < 0.7:
            w[random.randrange(40)] = "muslims"
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_fit_reaches_the_dense_optimum():
    """The loss, written out on dense matrices, has no slope where the fit ends."""
    rng = np.random.default_rng(3)
    n, width = 120, 9
    dense = rng.random((n, width)) < 0.3
    labels = (dense[:, 0] | (rng.random(n) < 0.15)).astype(float)
    swaps = [(i, np.array([1]), np.array([2])) for i in range(0, n, 3)]
    weights, bias = toxicity.fit([np.flatnonzero(r) for r in dense], labels, [(a, b) for _, a, b in swaps], width)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))

    def loss(v):
        z = dense @ v[:-1] + v[-1]
        change = np.array([v[a].sum() - v[b].sum() for _, a, b in swaps])
        return (share * (np.logaddexp(0, z) - labels * z)).sum() + toxicity.RIDGE / 2 * (v[:-1] ** 2).sum() + (change ** 2).mean() * toxicity.COUNTERFACTUAL

    best = np.append(weights, bias)
    slope = [(loss(best + e) - loss(best - e)) / 2e-5 for e in 1e-5 * np.eye(width + 1)]
    assert np.abs(slope).max() < 1e-3 and abs(weights[1] - weights[2]) < 0.2 < weights[0]


def test_training_takes_one_text_of_an_id(spark):
    docs, labels = labelled(spark)
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id % 7 = 0"))
    assert toxicity.train(twice, labels) == toxicity.train(docs, labels)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.score(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(out["doc_id"], out["held_out"]))
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert ((out["score"] >= 0.7).astype(int) == out["predicted"]).all()
    # naming a group moves a score less than it would without the penalty
    weights, _ = toxicity.train(docs, labels)
    plain, _ = toxicity.train(docs, labels, groups=())
    key = [f for f in toxicity.word_features("muslims") if f in plain]
    assert key and sum(abs(weights.get(f, 0)) for f in key) < 0.5 * sum(abs(plain[f]) for f in key)


def test_toxicity_edges(spark):
    docs, labels = labelled(spark)
    odd = docs.unionByName(spark.createDataFrame([(9000, None), (9001, ""), (None, "muckhead")], docs.schema))
    marks = labels.unionByName(spark.createDataFrame([(None, 1), (77777, 1), (3, None), (5, 0), (5, 0)], labels.schema))
    got = {r["doc_id"]: r for r in toxicity.score(odd, marks).collect()}
    assert got[9000]["score"] == got[9001]["score"] < 0.5 < got[None]["score"] and not got[None]["held_out"]
    flat = toxicity.score(docs, labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(flat) == 1 and 0 < flat[0][0] < 1
    assert toxicity.score(docs, labels.limit(0)).count() == 600 and toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.score(clashing(spark), labels).count() == len(awkward_rows())


def test_rollups(spark):
    store = rollups.Store(spark, scratch_path(spark, "roll"))
    docs = awkward(spark)
    count = rollups.word_count(F.col("text"))
    assert store.totals().count() == 0
    assert store.commit(1, rollups.changes(docs, "insert", "words", count))
    once = sorted(map(repr, store.totals().collect()))
    assert not store.commit(1, rollups.changes(docs, "insert", "words", count))
    assert sorted(map(repr, store.totals().collect())) == once
    assert store.commit(2, rollups.changes(docs, "revise", "words", count + 1, count))
    total = store.totals().agg(F.sum("documents"), F.sum("tokens")).first()
    n = len(awkward_rows())
    assert tuple(total) == (n, sum(len((r[1] or "").split()) for r in awkward_rows()) + n)
    assert store.commit(3, rollups.changes(docs, "delete", "words", F.lit(None), count + 1)) and store.totals().count() == 0
    assert store.commit(4, rollups.changes(empty(spark), "insert", "words", count)) and store.totals().count() == 0
    # a commit cut off before its marker counts for nothing, and is written anew
    path = f"{store.path}/batch={5:012d}"
    rollups.deltas(rollups.changes(docs, "insert", "words", count)).write.parquet(path)
    store.files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"), False)
    assert store.totals().count() == 0
    assert store.commit(5, rollups.changes(docs, "insert", "words", count)) and sorted(map(repr, store.totals().collect())) == once


def test_rollups_of_pieces(spark):
    library = pieces.load(MODEL).library
    rows = rollups.changes(clashing(spark), "insert", "piece_bpe_32k", rollups.piece_count(F.col("text"), MODEL))
    got = rollups.deltas(rows).agg(F.sum("tokens")).first()[0]
    assert got == sum(len(library.encode(r[1] or "")) for r in awkward_rows())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, monkeypatch):
    from tools import check
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "SQL", SQL)
    assert check.compare(spark, check.connect(SMALL), name, SMALL) == ""


def test_pipeline(spark):
    """All stages against brute force on the smallest tables."""
    import corpus_pipeline
    from tests.llm.helpers import brute_components
    from tests.llm.test_filters import brute_lines, brute_metrics
    from evalweave.llm.decontam import words_of
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [b" " + b" ".join(words_of(r["text"])) + b" " for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = []
    for r in docs:
        n, _, _, _, repeats = brute_metrics(r["text"])
        if n >= 50 and 100 * repeats <= 50 * n:
            rows.append((r["doc_id"], r["text"]))
    rows = [(d, t) for d, _, _, t in brute_lines(rows)]
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, brute_components(rows, 5, 80)) if c == d]
    rows = [(d, t) for d, t in rows if not any(i in b" " + b" ".join(words_of(t)) + b" " for i in items)]
    library = pieces.load(MODEL).library
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {d: library.encode(t) for d, t in rows}
    assert 0 < len(got) < len(docs)


def test_splits_are_weighted_medians_of_the_widest_dimension(spark):
    """The tree, walked again in plain Python: at each node all points of the left half lie before
    those of the right half, and no other cut between points comes nearer to its target."""
    rng = random.Random(21)
    bits = sharding.HASH_BITS * sharding.HASH_ROUNDS
    points = [(float(rng.choice([0, 0, 0, 1, 5, rng.random() * 9])), rng.random(), rng.getrandbits(bits - 1), rng.randint(1, 40)) for _ in range(400)]
    frame = spark.createDataFrame(points, "x0 double, x1 double, h bigint, weight bigint")
    for shards in (1, 6, 16):
        got = [tuple(r) for r in sharding.leaves(frame, shards, 2).select("x0", "x1", "h", "weight", "shard").collect()]
        assert sorted(p[:4] for p in got) == sorted(points) and {p[4] for p in got} == set(range(shards))
        spans = [max(p[d] for p in points) - min(p[d] for p in points) for d in (0, 1)]

        def walk(first, count):
            here = [p for p in got if first <= p[4] < first + count]
            if count == 1:
                return
            wide = [(max(p[d] for p in here) - min(p[d] for p in here)) / spans[d] for d in (0, 1)]
            d = max((0, 1), key=lambda k: (wide[k], -k))
            half, place = first + count // 2, lambda p: (p[d], p[2])
            left, right = [p for p in here if p[4] < half], [p for p in here if p[4] >= half]
            assert max(map(place, left)) < min(map(place, right))
            target = sum(p[3] for p in here) * (count // 2) / count
            cuts, total = [], 0
            for p in sorted(here, key=place):
                cuts.append(abs(total - target))
                total += p[3]
            assert abs(sum(p[3] for p in left) - target) == min(cuts)
            walk(first, count // 2)
            walk(half, count - count // 2)

        walk(0, shards)
