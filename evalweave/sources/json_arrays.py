"""JSON arrays in parallel, however large one file is.

Spark's own reader takes a file that is one JSON array in a single task. Here the file is cut
at every ``}``, which Spark's text reader does from any byte range on, and pieces are put
together to runs of about a megabyte. Where in the text a run begins, inside a string or at
which depth, depends on all before it; but what a run does to either state is known from the
run alone: its *transfer*. Transfers combine associatively, so a prefix over blocks, then
over the runs of a block, tells where each run begins. Runs are then cut into records on
their own. A record that spans runs leaves a piece in each; pieces are numbered by the records
that begin before them and put together.

The source is read once: runs are kept as Parquet, and all later steps read those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.ordering import running_total
from evalweave.session import materialize, scratch_path

RUN_BYTES = 1 << 20
#: A block or run, and what it makes of a beginning outside (0) and inside (1) of a string.
TRANSFER = {"ends0": pa.bool_(), "depth0": pa.int64(), "ends1": pa.bool_(), "depth1": pa.int64()}
BLOCK = {"path": pa.string(), "block": pa.int64()}
STATE = {"inside": pa.bool_(), "depth": pa.int64(), "base": pa.int64()}
RUN = {**BLOCK, "run": pa.int64(), "text": pa.binary(), "is_array": pa.bool_(), **TRANSFER}
WHOLE_BLOCK = {**BLOCK, "is_array": pa.bool_(), **TRANSFER}
BLOCK_START = {**BLOCK, **STATE, "sound": pa.bool_()}
RUN_START = {**BLOCK, "run": pa.int64(), **STATE}
TOKEN = re.compile(rb'"(?:[^"\\]+|\\.)*("?)|[\[\]{}]', re.S)
STRING_REST = re.compile(rb'(?:[^"\\]+|\\.)*("?)', re.S)


def ddl(fields: dict[str, pa.DataType]) -> str:
    names = {"bool": "boolean", "int64": "bigint"}
    return ", ".join(f"{name} {names.get(str(kind), str(kind))}" for name, kind in fields.items())


def tokens(text: bytes, inside: bool) -> Iterator[tuple[int, int]]:
    """(place, byte) of the brackets outside strings; last, (-1, whether it ends in a string)."""
    at = 0
    if inside:
        rest = STRING_REST.match(text)
        at = rest.end()
        if not rest[1]:
            yield -1, 1
            return
    for m in TOKEN.finditer(text, at):
        if m[0][0] != 34:
            yield m.start(), m[0][0]
        elif not m[1]:
            yield -1, 1
            return
    yield -1, 0


def transfer(text: bytes, inside: bool) -> tuple[bool, int]:
    """(whether it ends in a string, by how much the depth changes)."""
    depth = 0
    for at, byte in tokens(text, inside):
        if at < 0:
            return bool(byte), depth
        depth += 1 if byte in b"[{" else -1
    return inside, depth


def records(text: bytes, inside: bool, depth: int, base: int) -> Iterator[tuple[bytes, bool, bool]]:
    """(piece, whether it begins a record, whether it ends one) of a run; records are the
    objects whose outer depth is ``base``."""
    begin, opens = (0, False) if inside or depth > base else (None, True)
    for at, byte in tokens(text, inside):
        if at < 0:
            break
        depth += 1 if byte in b"[{" else -1
        if byte == 123 and depth == base + 1 and begin is None:
            begin, opens = at, True
        elif depth == base and begin is not None:
            yield text[begin:at + 1], opens, True
            begin = None
    if begin is not None:
        yield text[begin:], opens, False


def _runs(size: int):
    """Fragments of one block after the other to runs with their transfers."""
    def packed(place, run, parts):
        text = b"}".join([*parts, b""])
        is_array = text.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[") if place[1] == run == 0 else None
        row = [*place, run, text, is_array, *transfer(text, False), *transfer(text, True)]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, RUN.values())], list(RUN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, parts, held = None, 0, [], 0
        for batch in batches:
            places = zip(batch.column("path").to_pylist(), batch.column("block").to_pylist())
            for here, value in zip(places, batch.column("value").cast(pa.binary())):
                if here != place or held >= size:
                    if parts:
                        yield packed(place, number, parts)
                    number = number + 1 if here == place else 0
                    place, parts, held = here, [], 0
                value = value.as_py()
                parts.append(value)
                held += len(value) + 1
        if parts:
            yield packed(place, number, parts)
    return run


def _through(rows: list[dict], order: str, inside: bool, depth: int) -> list[tuple[bool, int]]:
    """States before each row, and behind the last."""
    states = [(inside, depth)]
    for r in sorted(rows, key=lambda r: r[order]):
        inside, depth = (r["ends1"], depth + r["depth1"]) if inside else (r["ends0"], depth + r["depth0"])
        states.append((inside, depth))
    return states


def _whole_block(table: pa.Table) -> pa.Table:
    """The transfer of all runs of a block."""
    rows = table.to_pylist()
    out = {"path": rows[0]["path"], "block": rows[0]["block"], "is_array": next((r["is_array"] for r in rows if r["is_array"] is not None), None)}
    for start in (0, 1):
        inside, depth = _through(rows, "run", bool(start), 0)[-1]
        out |= {f"ends{start}": inside, f"depth{start}": depth}
    return pa.Table.from_pylist([out], pa.schema(WHOLE_BLOCK))


def _block_starts(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    states = _through(rows, "block", False, 0)
    base = int(any(r["is_array"] for r in rows))
    # the last fragment is not followed by a bracket, but is counted as if it were
    sound = not base or states[-1] == (False, -1)
    return pa.Table.from_pylist([{"path": r["path"], "block": r["block"], "inside": s[0], "depth": s[1], "base": base, "sound": sound}
                                 for r, s in zip(rows, states)], pa.schema(BLOCK_START))


def _run_starts(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["run"])
    states = _through(rows, "run", rows[0]["inside"], rows[0]["depth"])
    return pa.Table.from_pylist([{"path": r["path"], "block": r["block"], "run": r["run"], "inside": s[0], "depth": s[1], "base": r["base"]}
                                 for r, s in zip(rows, states)], pa.schema(RUN_START))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "at", "nth", "opens", "closes", "text"]
    for batch in batches:
        for r in batch.to_pylist():
            found = list(records(r["text"], r["inside"], r["depth"], r["base"]))
            if found:
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * n), pa.array([r["block"] + r["run"]] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array([x[1] for x in found]), pa.array([x[2] for x in found]),
                     pa.array([x[0] for x in found], pa.binary()).cast(pa.string())], names)


def read_json_arrays(spark: SparkSession, path: str, schema: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(ord, *fields of ``schema``): the objects of JSON array files, or of files that hold one
    object after the other. ``ord`` sorts as they lie in the files. Elements of an array must be
    objects; an array that does not end raises ValueError.
    """
    fragments = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    kept = scratch_path(spark, "json-runs")
    fragments.mapInArrow(_runs(run_bytes), ddl(RUN)).write.parquet(kept)
    runs = spark.read.parquet(kept)
    narrow = runs.drop("text")
    blocks = narrow.groupBy("path", "block").applyInArrow(_whole_block, ddl(WHOLE_BLOCK))
    starts = materialize(blocks.groupBy("path").applyInArrow(_block_starts, ddl(BLOCK_START)))
    torn = starts.where("not sound").select("path").first()
    if torn:
        raise ValueError(f"the array in {torn.path} does not end")
    begins = narrow.join(starts, ["path", "block"]).groupBy("path", "block").applyInArrow(
        _run_starts, ddl(RUN_START))
    cut = scratch_path(spark, "json-records")
    runs.select("path", "block", "run", "text").join(begins, ["path", "block", "run"]).mapInArrow(
        _cut, "path string, at bigint, nth int, opens boolean, closes boolean, text string").write.parquet(cut)
    pieces = spark.read.parquet(cut)
    whole = pieces.where("opens and closes").select("path", "at", "nth", "text")
    # in a run at most one piece goes on from before, and at most one goes on behind it
    parts = pieces.where("not (opens and closes)").withColumn("place", 2 * F.col("at") + F.col("opens").cast("bigint"))
    numbers = running_total(parts.select("path", "place", "opens"), "place", "path", F.col("opens").cast("bigint"), start="before").select(
        "path", "place", (F.col("before") + F.col("opens").cast("bigint")).alias("record"))
    joined = parts.join(numbers, ["path", "place"]).groupBy("path", "record").agg(
        F.min("at").alias("at"), F.min_by("nth", "place").alias("nth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "").alias("text"))
    every = whole.unionByName(joined.select("path", "at", "nth", "text"))
    return every.select(F.struct("path", "at", "nth").alias("ord"), F.from_json("text", schema).alias("r")).select("ord", "r.*")
