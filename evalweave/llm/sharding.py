"""K-d tree sharding: shards of nearly equal bytes, each a box of metadata space.

Documents are points in a space of metadata (size, language, source). The node that
still holds several shards is split at the weighted median of its widest dimension,
measured against the whole table, until each leaf holds one shard's share of bytes.
A median is found by sums over bins, refined round by round: first by value, then,
among equal values, by text hash. Only those sums (a fixed number a level) reach the
driver; the same rounds serve all nodes of a level.

Equal texts form one group, a single point with the metadata of their smallest id, and
go to one shard. A group over 1/64 of a shard is cut into pieces that may part, so that
sizes stay near equal even if copies hold a third of all bytes.

Nulls: a null text has size 1; null metadata is the smallest value; null ids are
numbered like others. Repeated rows each take a slot. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.llm.common import pinned

SHARDS = 16
HEAVY = 64
VALUE_BINS, HASH_BITS, HASH_ROUNDS = 1024, 12, 3
SLOT_BLOCKS = 4096


def text_coordinate(name: str) -> Column:
    """A number that sorts as the first six bytes of a string."""
    head = F.rpad(F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(0.0))


def dimensions(names: list[str]) -> list[Column]:
    return [F.log2(F.col("size").cast("double")), *[text_coordinate(n) for n in names]]


def _pick(values: list, kind: str = "double") -> Column:
    """The node's own entry of a list with one value a node."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("node") + 1)


def _sums(rows: DataFrame, bin_: Column, nodes: int) -> list[dict[int, int]]:
    found = [{} for _ in range(nodes)]
    for r in rows.groupBy("node", bin_.cast("bigint").alias("bin")).agg(F.sum("weight").alias("w")).collect():
        found[r["node"]][r["bin"]] = r["w"]
    return found


def _cross(sums: dict[int, int], wanted: float) -> tuple[int, float]:
    """The bin in which the running sum passes ``wanted``, and what is wanted inside it."""
    last = max(sums, default=0)
    for b in sorted(sums):
        if wanted < sums[b] or b == last:
            return b, wanted
        wanted -= sums[b]
    return last, 0.0


def split_level(points: DataFrame, shards: list[int], spans: list[float]) -> list[tuple | None]:
    """One split (dimension, low, high, hash cut) for each node of the level; None for a leaf."""
    n, dims = len(shards), len(spans)
    stats = {r["node"]: r for r in points.groupBy("node").agg(
        F.sum("weight").alias("w"), *[f(f"x{d}").alias(f"{k}{d}") for d in range(dims) for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
    live = [i for i in range(n) if shards[i] > 1 and i in stats]
    if not live:
        return [None] * n
    dim, low, high, wanted = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for i in live:
        s = stats[i]
        dim[i] = max(range(dims), key=lambda d: ((s[f"hi{d}"] - s[f"lo{d}"]) / spans[d] if spans[d] else 0, -d))
        low[i], high[i] = s[f"lo{dim[i]}"], math.nextafter(s[f"hi{dim[i]}"], math.inf)
        wanted[i] = s["w"] * (shards[i] // 2) / shards[i]
    x = F.element_at(F.array(*[F.col(f"x{d}") for d in range(dims)]), _pick(dim, "int") + 1)
    inside = points.where(F.col("node").isin(live)).withColumn("x", x).select("node", "x", "h", "weight")
    for _ in range(2):
        slab = inside.where((F.col("x") >= _pick(low)) & (F.col("x") < _pick(high)))
        width = [max((b - a) / VALUE_BINS, 5e-324) for a, b in zip(low, high)]
        bin_ = F.least(F.floor((F.col("x") - _pick(low)) / _pick(width)), F.lit(VALUE_BINS - 1))
        for i, s in enumerate(_sums(slab.select("node", "weight", bin_.alias("b")), F.col("b"), n)):
            if s:
                b, wanted[i] = _cross(s, wanted[i])
                # the same rounding on both sides of an edge: a bin's edge is the least value in it
                low[i], high[i] = low[i] + b * width[i], high[i] if b == VALUE_BINS - 1 else low[i] + (b + 1) * width[i]
    slab = inside.where((F.col("x") >= _pick(low)) & (F.col("x") < _pick(high)))
    cut = [0] * n
    rest = dict(enumerate(_below(inside, low, n)))
    for i in live:
        wanted[i] = stats[i]["w"] * (shards[i] // 2) / shards[i] - rest[i]
    for r in range(HASH_ROUNDS):
        shift = HASH_BITS * (HASH_ROUNDS - 1 - r)
        here = slab.where(F.shiftright("h", shift + HASH_BITS) == _pick([c >> HASH_BITS for c in cut] if r == 0 else cut, "bigint")) if r else slab
        sums = _sums(here.select("node", "weight", F.shiftright("h", shift).alias("b")), F.col("b"), n)
        for i in live:
            b, wanted[i] = _cross(sums[i], wanted[i])
            if r == HASH_ROUNDS - 1 and wanted[i] > sums[i].get(b, 0) / 2:
                b += 1  # the nearer side of the last point
            cut[i] = b
    return [(dim[i], low[i], high[i], cut[i]) if i in live else None for i in range(n)]


def _below(inside: DataFrame, low: list[float], n: int) -> list[int]:
    sums = _sums(inside.where(F.col("x") < _pick(low)).select("node", "weight"), F.lit(0), n)
    return [s.get(0, 0) for s in sums]


def goes_left(split: tuple) -> Column:
    d, low, high, cut = split
    x = F.col(f"x{d}")
    return (x < F.lit(low)) | ((x < F.lit(high)) & (F.col("h") < F.lit(cut)))


def leaves(points: DataFrame, shards: int, dims: int) -> DataFrame:
    """``points`` (pinned: x0.., h, weight) with the shard each falls into."""
    ends = points.agg(*[f(f"x{d}") for d in range(dims) for f in (F.min, F.max)]).first()
    spans = [(ends[2 * d + 1] or 0) - (ends[2 * d] or 0) for d in range(dims)]
    counts, first = [shards], [0]
    node = F.lit(0)
    while max(counts) > 1:
        splits = split_level(points.withColumn("node", node), counts, spans)
        cases, new_counts, new_first = F.lit(None).cast("int"), [], []
        parent = node
        for i, c in enumerate(counts):
            here = len(new_counts)
            if c == 1 or splits[i] is None:
                cases = F.when(parent == i, F.lit(here)).otherwise(cases)
                new_counts.append(1)
                new_first.append(first[i])
            else:
                cases = F.when(parent == i, F.when(goes_left(splits[i]), here).otherwise(here + 1)).otherwise(cases)
                new_counts += [c // 2, c - c // 2]
                new_first += [first[i], first[i] + c // 2]
        points = pinned(points.withColumn("__node", cases).drop("node").withColumnRenamed("__node", "node"), "kd")
        counts, first, node = new_counts, new_first, F.col("node")
    shard = F.element_at(F.array(*[F.lit(f) for f in first]), F.col("node") + 1) if shards > 1 else F.lit(0)
    return points.withColumn("shard", shard.cast("int"))


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text",
           metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, and its slot, gapless from 0 in its shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("g1"),
        F.xxhash64(F.lit(1), body).alias("g2"), *[F.col(m).alias(f"m{k}") for k, m in enumerate(metadata)])
    rows = pinned(rows, "sizes")
    places = dimensions([f"m{k}" for k in range(len(metadata))])
    names = [f"x{d}" for d in range(len(places))]
    groups = pinned(rows.select("g1", "g2", "size", "doc_id", F.struct(*[p.alias(x) for p, x in zip(places, names)]).alias("at"))
                    .groupBy("g1", "g2").agg(F.sum("size").alias("weight"), F.min_by("at", F.struct("doc_id", "at")).alias("at")), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    limit = max(1.0, total / shards / HEAVY)
    # these weigh over the limit each, so there are at most shards * HEAVY of them
    heavy = groups.where(F.col("weight") > limit).select(
        "g1", "g2", "at", F.ceil(F.col("weight") / limit).alias("pieces"))
    heavy_keys = F.broadcast(heavy.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "pieces"))
    piece = F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces")))
    rows = pinned(rows.join(heavy_keys, (F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2")), "left").select(
        "doc_id", "size", "text_crc32", "g1", "g2", piece.cast("bigint").alias("piece")), "pieces")
    low_bits = (1 << HASH_BITS) - 1
    top = F.shiftleft(F.shiftrightunsigned("g1", 64 - HASH_BITS * (HASH_ROUNDS - 1)), HASH_BITS)
    whole = groups.where(F.col("weight") <= limit).select(
        "g1", "g2", F.lit(-1).cast("bigint").alias("piece"), "weight", "at.*", top.bitwiseOR(F.col("g1").bitwiseAND(low_bits)).alias("h"))
    cut = rows.where("piece >= 0").groupBy("g1", "g2", "piece").agg(F.sum("size").alias("weight")).join(
        F.broadcast(heavy.select("g1", "g2", "at")), ["g1", "g2"]).select(
        "g1", "g2", "piece", "weight", "at.*", top.bitwiseOR(F.xxhash64("piece").bitwiseAND(low_bits)).alias("h"))
    placed = leaves(pinned(whole.unionByName(cut), "points"), shards, len(names)).select("g1", "g2", "piece", "shard")
    rows = pinned(rows.join(placed, ["g1", "g2", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", "g1",
        F.pmod(F.xxhash64("doc_id", "g1"), F.lit(SLOT_BLOCKS)).cast("int").alias("block")), "placed")
    # at most shards * SLOT_BLOCKS rows
    offsets = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "g1"))
    return rows.withColumn("at", inside).join(F.broadcast(offsets), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("bigint").alias("slot"))
