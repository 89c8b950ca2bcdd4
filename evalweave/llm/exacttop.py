"""Exact top-k by inner product: branch and bound over columns.

Vectors are whole numbers, ``floor(1024 * x)`` of each component, in blocks that are stored
column by column. A query goes through a block's columns a few at a time, the heaviest first:

1. Each candidate gains the part of its score that these columns make.
2. What the other columns can still add or take is at most the product of the lengths of the
   two remainders (Cauchy-Schwarz), so each candidate has a lower and an upper bound.
3. Candidates whose upper bound is under the k-th best lower bound are dropped, and the
   arrays of the others closed up.

Those that remain at the end have exact scores. Queries are gathered in blocks as well, and
each block of queries meets each block of candidates once: the queries are sent to all
tasks where their measured size permits, else both are shuffled by query block and lane.

Scores are exact; where a sum could leave the range in which doubles are whole numbers, Python's
integers take over, and a score beyond 64 bits becomes the largest or smallest of them. Vectors
that are null or hold null, NaN or infinite components take no part; empty ones do, with score
0. A shorter vector counts as zero where it has no component. Null ids are no queries and are carried as
candidates, last among equal scores. Rows that repeat a query's id are all its own, and no
candidates of it; an id with different vectors has a ranking for each, told apart by ``query_hash``. Other
repeated rows count each. Empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import pinned, ranked, small_batches
from evalweave.operators.sizes import BROADCAST_BYTES

TOP, EVERY, SCALE = 10, 100, 1024
#: Columns a step.
STEP = 8
#: Cells of a block of candidates; queries of a block, about; blocks of candidates in a lane.
BLOCK_CELLS, BLOCK_ROWS, QUERIES, LANE = 1 << 19, 8192, 512, 16
#: Doubles are exact below this.
EXACT = float(1 << 53)
#: Entries that a task remembers before it hands them on.
HELD = 1 << 16
BLOCK = "n int, dims int, ids binary, known binary, cells binary"
FIELDS = ["n", "dims", "ids", "known", "cells"]


def _matrix(batch) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    lists = batch.column("v")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values[ends[0]:ends[-1]]
    return out


def _packed(ids: list, parts: list[np.ndarray]) -> list:
    dims = max(p.shape[1] for p in parts)
    cells = np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])
    return [len(ids), dims, np.array([i or 0 for i in ids], np.int64).tobytes(),
            np.array([i is not None for i in ids], np.uint8).tobytes(), np.ascontiguousarray(cells.T).tobytes()]


def _as_batch(row: list, more: dict | None = None):
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    arrays = [pa.array([x], k) for x, k in zip(row, kinds)] + [pa.array([x], pa.int64()) for x in (more or {}).values()]
    return arrays, [*FIELDS, *(more or {})]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, parts = [], []
    for batch in batches:
        names, rows = batch.column("vec_id").to_pylist(), _matrix(batch)
        most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, rows.shape[1], *(p.shape[1] for p in parts))))
        while len(names):
            take = most - len(ids)
            if take > 0:
                ids += names[:take]
                parts.append(rows[:take])
                names, rows = names[take:], rows[take:]
            if len(ids) >= most:
                yield pa.RecordBatch.from_arrays(*_as_batch(_packed(ids, parts)))
                ids, parts = [], []
    if ids:
        yield pa.RecordBatch.from_arrays(*_as_batch(_packed(ids, parts)))


def _query_block(rows: pa.Table) -> pa.Table:
    packed = _packed(rows.column("vec_id").to_pylist(), [_matrix(rows)])
    arrays, names = _as_batch(packed, {"qb": rows.column("qb")[0].as_py()})
    hashes = pa.array([np.asarray(rows.column("query_hash")).astype(np.int64).tobytes()], pa.binary())
    return pa.table([*arrays, hashes], [*names, "hashes"])


class Columns:
    """A block of candidates, column by column."""

    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8) > 0
        self.whole = np.frombuffer(row["cells"], np.int64).reshape(row["dims"], row["n"])
        self.cells = self.whole.astype(np.float64)
        self.squares = self.cells * self.cells
        self.mass = self.squares.sum(1)
        self.lengths = self.squares.sum(0)
        self.largest = float(np.abs(self.cells).max(initial=0))

    def best(self, query: np.ndarray, own: int, top: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, exact scores); all of at least the top-th best score are there.
        ``floor`` is a score that ``top`` candidates elsewhere reach."""
        alive = np.flatnonzero(~(self.known & (self.ids == own)))
        dims = min(len(query), len(self.cells))
        big = np.abs(query.astype(np.float64)).max(initial=0)
        if max(big * self.largest, big * big, self.largest * self.largest) * max(len(query), len(self.cells), 1) >= EXACT:
            rows = self.whole[:dims, alive].astype(object)
            scores = query[:dims].astype(object) @ rows if dims else np.zeros(len(alive), object)
            return alive, np.array([min(max(int(s), -1 << 63), (1 << 63) - 1) for s in scores], np.int64)
        q = query.astype(np.float64)
        order = np.argsort(-(q[:dims] ** 2) * self.mass[:dims], kind="stable")
        floor = -np.inf if floor is None else floor
        scores, rest, mine = np.zeros(len(alive)), self.lengths[alive], float(q @ q)
        for lo in range(0, dims, STEP):
            at = order[lo:lo + STEP]
            full = len(alive) == len(self.ids)
            scores = scores + q[at] @ (self.cells[at] if full else self.cells[np.ix_(at, alive)])
            rest = rest - (self.squares[at] if full else self.squares[np.ix_(at, alive)]).sum(0)
            mine -= float(q[at] @ q[at])
            if lo + STEP >= dims:
                break
            slack = np.sqrt(np.maximum(rest, 0) * max(mine, 0)) * (1 + 1e-9) + 1
            if len(alive) >= top:
                floor = max(floor, np.partition(scores - slack, len(alive) - top)[-top])
            keep = scores + slack >= floor
            if not keep.all():
                alive, scores, rest = alive[keep], scores[keep], rest[keep]
        keep = scores >= floor
        return alive[keep], scores[keep].astype(np.int64)


def _search(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}

        def handed_on():
            for (query, code), (scores, ids, known) in best.items():
                n = len(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * n, pa.int64()), pa.array([code] * n, pa.int64()),
                     pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())],
                    ["query_id", "query_hash", "vec_id", "score"])
            best.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                block = Columns(row)
                queries = np.frombuffer(row["q_cells"], np.int64).reshape(row["q_dims"], row["q_n"]).T
                for query, own, code in zip(queries, np.frombuffer(row["q_ids"], np.int64).tolist(),
                                            np.frombuffer(row["q_hashes"], np.int64).tolist()):
                    before = best.get((own, code))
                    floor = int(before[0][-1]) if before and len(before[0]) == top else None
                    found, scores = block.best(query, own, top, floor)
                    ids, known = block.ids[found], block.known[found]
                    if before:
                        scores, ids, known = (np.concatenate(x) for x in zip(before, (scores, ids, known)))
                    order = np.lexsort((ids, ~known, np.invert(scores)))[:top]
                    if len(order):
                        best[own, code] = scores[order], ids[order], known[order]
                if len(best) > HELD:
                    yield from handed_on()
        yield from handed_on()
    return run


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("e").isNotNull() & F.coalesce(good, F.lit(False))).select(
        "vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score and query_hash: for each row whose id is divisible by
    ``every``, the ``top`` rows of another id with the highest inner product, ties to the smaller id."""
    small_batches(vectors.sparkSession)
    rows = whole_vectors(vectors, vec_id, embedding)
    blocks = pinned(rows.mapInArrow(_blocks, BLOCK), "vector-blocks")
    asked = pinned(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn(
        "query_hash", F.xxhash64("v")), "queries")
    count = -(-asked.count() // QUERIES)
    lanes = max(1, -(-blocks.count() // LANE))
    queries = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "query_hash"), F.lit(max(1, count)))).groupBy("qb").applyInArrow(
        _query_block, BLOCK + ", qb bigint, hashes binary").select(
        *[F.col(c).alias(f"q_{c}") for c in FIELDS], "qb", F.col("hashes").alias("q_hashes"))
    queries = pinned(queries, "query-blocks")
    size = F.octet_length("q_cells") + F.octet_length("q_ids")
    if queries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        queries = F.broadcast(queries.withColumn("lane", F.lit(0)))
        lanes = 1
    else:
        queries = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    each = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))) if count else F.lit(None).cast("bigint"))
    pairs = each.join(queries, ["qb", "lane"]).drop("qb", "lane", "q_known")
    found = pairs.mapInArrow(_search(top), "query_id bigint, query_hash bigint, vec_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    return ranked(found, ["query_id", "query_hash"], order, "vec_id", top).select("query_id", "rank", "vec_id", "score", "query_hash")
