"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

All tokens (hashed shingles) share one global order: rare first, by a sketch that
counts them over all documents. Two sets of Jaccard similarity theta or more share at
least l tokens among the first ``n - ceil(theta * n) + l`` of each, for every l. Each
document lengthens its prefix (picks its l) by what the sketch says its prefix
would cost in candidates, and a pair is verified only if it shares as many
prefix tokens as the larger l of the two.

Documents with equal sets are one class and take part once. Tokens that the sketch puts
at ``DENSE`` documents or more emit no pairs: a document lengthens its prefix until
the others alone must match. Where that is impossible, as in a large family of near
copies, a star per token joins such documents into a cluster, and clusters are compared
block by block in numpy, which hands back a spanning forest of the links only.

Shingles are 64-bit and classes 128-bit hashes. Nulls: a null or wordless text has no
set and links with nothing; null ids take part, but never name a component that has
another id. Repeated rows fall into one class. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import nested, pinned, small_batches
from evalweave.llm.components import components
from evalweave.operators.sizes import measured

#: Bins of the token sketch, a fixed size (one byte each once it is broadcast).
SKETCH_BITS = 22
#: Every prefix is long enough for three matches: three more tokens to index cost less than
#: verifying what shares one by chance.
MIN_MATCHES, MAX_MATCHES = 3, 8
DENSE = 128
#: Tokens in one block of a dense cluster, on average.
BLOCK_TOKENS = 1 << 18
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes. ASCII case and the six ASCII blanks are folded;
    shorter texts are one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(b" ".join(found), len(found))], np.uint64).view(np.int64)
    h = np.array([digest(w) for w in found], np.uint64)
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ h[k:k + n]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _bins(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _classes(words: int):
    """Per row its class and set size; last, per partition, the token sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            sigs = [signature(s) if len(s) else None for s in sets]
            for sig, s in zip(sigs, sets):
                if sig is not None and sig not in seen:  # copies count once, as far as this memory goes
                    seen.add(sig)
                    np.add.at(sketch, _bins(s), 1) if len(s) < 64 else _add(sketch, _bins(s))
            if len(seen) > 1 << 20:
                seen.clear()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "sig": sigs, "n": [len(s) for s in sets], "sketch": None})
        yield pd.DataFrame({"doc_id": [None], "sig": [None], "n": [-1], "sketch": [zlib.compress(sketch, 1)]})
    return run


def _add(sketch: np.ndarray, bins: np.ndarray) -> None:
    at, count = np.unique(bins, return_counts=True)
    sketch[at] += count.astype(np.uint32)


def _unpacked(packed: bytes) -> Iterator[np.ndarray]:
    """Counts of a sketch, a megabyte at a time."""
    unpack = zlib.decompressobj()
    while not unpack.eof:
        if piece := unpack.decompress(packed, 1 << 20):
            yield np.frombuffer(piece, np.uint32)
        packed = unpack.unconsumed_tail


def _sum_sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts end at the largest they can hold."""
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        for x in batch["sketch"]:
            at = 0
            for more in _unpacked(x):
                part = total[at:at + len(more)]
                part += more
                part[part < more] = 2**32 - 1
                at += len(more)
    yield pd.DataFrame({"sketch": [zlib.compress(total, 1)]})


def levels(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per bin that keeps the order of the counts (255 levels), and for each
    level an estimate of a token's frequency: the count over what a bin usually holds."""
    cuts = np.unique(np.concatenate([
        np.quantile(sketch, np.linspace(0, 1, 128)), np.geomspace(max(1, np.median(sketch)), max(2, sketch.max()), 126)]))[1:]
    level = np.searchsorted(cuts, sketch, side="left").astype(np.uint8)
    frequency = np.maximum(1, np.concatenate([[0], cuts])[:256] - np.median(sketch))
    return level, frequency


def prefix(tokens: np.ndarray, level: np.ndarray, frequency: np.ndarray, percent: int):
    """(tokens, tier of each, matches l, dense or not, matches wanted of tokens that are not).

    A partner shares l tokens of the l-prefix; those that are not dense are then at least
    l less the dense ones in it."""
    n = len(tokens)
    least = -(-percent * n // 100)
    rank = level[_bins(tokens)]
    longest = min(n, n - least + min(MAX_MATCHES, least))
    order = np.lexsort((tokens, rank))[:longest]
    base = n - least + 1
    each = frequency[rank[order]]
    cost = float((each[:base] - 1).sum())
    matches = int(min(MAX_MATCHES, least, MIN_MATCHES + np.ceil(np.log2(1 + cost) / 2)))
    tier = np.maximum(1, np.arange(1, longest + 1) - base + 1)
    dense = each >= DENSE
    return tokens[order], tier, matches, dense, max(0, matches - int(dense[:base + matches - 1].sum()))


def _prefixes(words: int, percent: int, shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, frequency = levels_of(shared)
        seen = set()
        for batch in batches:
            token, sig, n, tier, matches, dense, wanted = [], [], [], [], [], [], []
            for text in batch["text"]:
                tokens = shingle_set(text, words)
                if not len(tokens) or (name := signature(tokens)) in seen:
                    continue
                seen.add(name)
                kept, tiers, ell, frequent, least = prefix(tokens, level, frequency, percent)
                # dense tokens matter only where they alone could make up the matches
                use = ~frequent | (least == 0) & (tiers <= ell)
                token.append(kept[use])
                tier.append(tiers[use])
                dense.append(frequent[use])
                count = int(use.sum())
                sig += [name] * count
                n += [len(tokens)] * count
                matches += [ell] * count
                wanted += [least] * count
            if len(seen) > 1 << 20:
                seen.clear()  # only a saving: later steps collapse copies anyway
            if sig:
                yield pd.DataFrame({"token": np.concatenate(token), "sig": sig, "n": n, "tier": np.concatenate(tier),
                                    "matches": matches, "wanted": wanted, "dense": np.concatenate(dense)})
    return run


def levels_of(shared):
    return shared.value


def _pairs(percent: int):
    """Sorted (token, sig) rows to candidate pairs, or to a star where a group is dense."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, token = [], None
        out: list[tuple] = []

        def flush():
            # one row per class; more than DENSE of them make a star
            for i in range(1, len(rows)):
                for j in range(i):
                    a, b = rows[j], rows[i]
                    # the one that wants more decides, by its own l. Where dense tokens may make
                    # up all matches of both, they share a star or one token that is not dense
                    if a[4] or b[4]:
                        ell, wanted = (a[3], a[4]) if a[4] >= b[4] else (b[3], b[4])
                    else:
                        ell, wanted = min(a[3], b[3]), 1
                    if a[2] <= ell and b[2] <= ell and 100 * min(a[1], b[1]) >= percent * max(a[1], b[1]):
                        out.append((a[0], b[0], wanted))
        pivot = None
        for batch in batches:
            tokens = batch["token"].to_numpy()
            if not len(tokens):
                continue
            edge = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            lone = edge & np.concatenate([edge[1:], [False]])
            if token is None or tokens[0] != token:
                first_continues = False
            else:
                first_continues = True
            lone[0] &= not first_continues
            keep = np.flatnonzero(~lone)
            sub = batch.iloc[keep]
            for t, s, *about in zip(sub["token"].to_numpy(), sub["sig"], sub["n"].tolist(), sub["tier"].tolist(), sub["matches"].tolist(), sub["wanted"].tolist()):
                if t != token:
                    if pivot is None:
                        flush()
                    rows, token, pivot = [], t, None
                if pivot is not None:
                    if s != pivot:
                        out.append((pivot, s, 0))
                elif not rows or rows[-1][0] != s:
                    rows.append((s, *about))
                    if len(rows) > DENSE:
                        pivot = rows[0][0]
                        out += [(pivot, r[0], 0) for r in rows[1:]]
                        rows = []
            if lone[-1]:  # its group may go on in the next batch
                if pivot is None:
                    flush()
                last = batch.iloc[-1]
                rows, token, pivot = [(last["sig"], last["n"], last["tier"], last["matches"], last["wanted"])], tokens[-1], None
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b", "wanted"])
                out = []
        if pivot is None:
            flush()
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "wanted"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({"sig": [signature(s) if len(s) else None for s in sets], "tokens": [s.tolist() for s in sets]})
    return run


def _block_links(percent: int):
    """Links within a cell as a spanning forest."""
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("sig").reset_index(drop=True)
        sets = [np.asarray(t, np.int64) for t in cell["tokens"]]
        n = np.array([len(s) for s in sets])
        own = np.repeat(np.arange(len(sets)), n)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, own = every[order], own[order]
        parent = np.arange(len(sets))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        edges = []
        for i, s in enumerate(sets):
            lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            overlap = np.bincount(np.concatenate([own[a:b] for a, b in zip(lo, hi)]), minlength=len(sets))
            near = np.flatnonzero(100 * overlap >= percent * (n + n[i] - overlap))
            for j in near[near > i].tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    edges.append((cell["sig"][i], cell["sig"][j]))
        return pd.DataFrame(edges, columns=["a", "b"])
    return run


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: doc_id, n (set size), sig (its class) and root (of its component, a
    class); and the components of classes that have links."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # ids travel as text: pandas would round large integers next to nulls
    classes = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        _classes(words), "doc_id string, sig binary, n bigint, sketch binary")
    classes = pinned(classes.withColumn("doc_id", F.col("doc_id").cast("bigint")), "classes")
    total = classes.where("n < 0").select("sketch").repartition(8).mapInPandas(_sum_sketches, "sketch binary")
    total = total.repartition(1).mapInPandas(_sum_sketches, "sketch binary").first()
    sketch = np.frombuffer(zlib.decompress(total[0]), np.uint32) if total else np.zeros(1 << SKETCH_BITS, np.uint32)
    shared = spark.sparkContext.broadcast(levels(sketch))

    index = pinned(rows.select("text").mapInPandas(
        _prefixes(words, percent, shared), "token bigint, sig binary, n int, tier int, matches int, wanted int, dense boolean"), "prefixes")
    low = index.where("not dense").drop("dense").repartition("token").sortWithinPartitions("token", "sig")
    found = pinned(low.mapInPandas(_pairs(percent), "a binary, b binary, wanted int"), "pairs")
    wanted = found.where("wanted > 0").groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.max("wanted").alias("wanted")).where("shared >= wanted").select("a", "b")
    # frequent tokens by the sketch: the star's centre is a pre-aggregated minimum
    hot = index.where("dense").select("token", "sig").distinct()
    star = hot.join(hot.groupBy("token").agg(F.min("sig").alias("a")), "token").select("a", F.col("sig").alias("b"))
    stars = found.where("wanted = 0").select("a", "b").unionByName(star)
    clusters = components(stars)
    # a cluster compares all its members, so that pairs inside one need not be
    for end in ("a", "b"):
        wanted = wanted.join(clusters.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    wanted = pinned(wanted.where("a_root is null or b_root is null or a_root != b_root").select("a", "b"), "candidates")

    involved = wanted.select(F.col("a").alias("sig")).unionByName(wanted.select(F.col("b").alias("sig"))).unionByName(
        clusters.select(F.col("node").alias("sig"))).distinct()
    named = classes.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    ids = measured(named.join(involved, "sig", "left_semi").select("doc_id"))
    sets = rows.join(ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text").mapInPandas(
        _sets(words), "sig binary, tokens array<bigint>").where("sig is not null")
    sets = pinned(sets.dropDuplicates(["sig"]), "sets")

    size = F.size("tokens")
    pairs = wanted.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    links = pairs.where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")

    members = sets.join(clusters, sets["sig"] == clusters["node"]).select("root", "sig", "tokens")
    blocks = members.groupBy("root").agg(F.ceil(F.sum(size) / BLOCK_TOKENS).alias("blocks"))
    cells = members.join(blocks, "root").withColumn(
        "block", F.pmod(F.xxhash64("sig"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = cells.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "tokens")
    dense_links = inside.groupBy("root", "i", "j").applyInPandas(_block_links(percent), "a binary, b binary")

    roots = components(links.unionByName(dense_links))
    groups = classes.where("n >= 0").join(roots, classes["sig"] == roots["node"], "left").select(
        "doc_id", "n", "sig", F.coalesce("root", "sig").alias("root"))
    return pinned(groups, "groups"), roots


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
         percent: int = 90) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable
    by links, itself included) and class_id (the smallest id with the same set)."""
    groups, roots = _grouped(docs, doc_id, text, words, percent)
    # the smallest id of each class and component, pre-aggregated; rows that are alone in
    # both name themselves
    names = groups.where("sig is not null").groupBy("sig").agg(
        F.first("root").alias("root"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    heads = roots.select(F.col("root").alias("sig")).distinct().withColumn("heads", F.lit(True))
    names = pinned(names.join(heads, "sig", "left").where("copies > 1 or root != sig or heads").drop("heads", "copies"), "names")
    tops = names.groupBy("root").agg(F.min("class_id").alias("component_id"))
    # both sides of this join are read from files, so that adaptive execution may split a
    # class that holds a large share of the rows
    names = pinned(names.join(tops, "root").select(F.col("sig").alias("s"), "class_id", "component_id"), "class-names")
    out = groups.join(names, groups["sig"] == names["s"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce("class_id", "doc_id").alias("class_id"))


def _sigs(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "sig": [signature(s) if len(s) else None for s in sets]})
    return run


def first_of_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                   percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last; of
    several such rows the one with the smallest hash of its text, then of all its columns. Rows
    without words are in no component and stay."""
    groups, _ = _grouped(docs, doc_id, text, words, percent)
    # components with more than one row; only their rows need their texts' hashes
    many = groups.where("sig is not null").groupBy("root").agg(F.count("*").alias("rows")).where("rows > 1")
    classes = groups.where("sig is not null").select("sig", "root").distinct().join(many.select("root"), "root")
    rows = docs.select(F.col(doc_id).cast("bigint").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    ids = measured(groups.join(classes, "sig", "left_semi").select(F.col("doc_id").alias("__i")).distinct())
    rows = rows.join(ids, rows["doc_id"].cast("bigint").eqNullSafe(ids["__i"]), "left_semi")
    named = rows.mapInPandas(_sigs(words), "doc_id string, text_hash bigint, sig binary").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # copies of one id and text first, which a large group may have many of
    named = named.groupBy("sig", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    members = pinned(named.join(classes, "sig").select("root", "doc_id", "text_hash", "copies"), "members")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    judged = members.join(first, "root").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "copies",
        (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash"))).alias("stays"))
    judged = pinned(judged, "judged")
    d = F.col("d")
    here = nested(docs).withColumns({"__d": d[doc_id].cast("bigint"), "__h": F.xxhash64(d[text].cast("string"))})
    same = [F.col("__d").eqNullSafe(F.col("__id")), F.col("__h") == F.col("__hash")]
    kept = here.join(measured(judged.where("not stays").select("__id", "__hash").distinct()), same, "left_anti")
    again = measured(judged.where("stays and copies > 1").select("__id", "__hash"))
    if again.isEmpty():
        return kept.select("d.*")
    one = kept.join(again, same, "left_semi").groupBy("__d", "__h").agg(F.min_by("d", F.xxhash64(F.to_json("d"))).alias("d"))
    return kept.join(again, same, "left_anti").select("d.*").unionByName(one.select("d.*"))
