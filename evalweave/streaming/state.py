"""Run state that survives restarts.

A finished record replaces the stored one of its key. Each micro-batch adds one delta,
so writing costs what the batch holds and not what the state holds. Deltas have their order
from the commit log, not from a clock, and a repeated batch finds its first commit there.
Reading resolves the last record per key over the compacted base and the deltas after it.

A base is a fold of all commits up to its *cut*. Streams may go on while it is
made: their deltas come after the cut, wherever the base itself is in the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.filters import request_succeeded
from evalweave.operators.ordering import dedup_last
from evalweave.sinks.commits import Conflict, Entry, commit, entries, new_data, remove

RUN_STATE = (
    "question_id string, question_title string, platform string, difficulty string, contest_date string,"
    " content string, reasoning_content string, parsed_code string, finish_reason string,"
    " ttft_seconds double, tpot_seconds double, elapsed_seconds double, usage map<string,bigint>,"
    " raw_response string, attempts int, error string, completed boolean, request_failed boolean"
)


def _base(log: Sequence[Entry]) -> Entry | None:
    return max((e for e in log if e.kind == "base"), key=lambda e: (e.more["cut"], e.number), default=None)


def _live(log: Sequence[Entry]) -> tuple[Entry | None, list[Entry]]:
    """The base and the deltas behind its cut."""
    base = _base(log)
    cut = base.more["cut"] if base else 0
    return base, [e for e in log if e.kind == "delta" and e.number > cut]


def _stored(log: Sequence[Entry]) -> dict[str, int]:
    """The last batch of each stream."""
    base, deltas = _live(log)
    last = dict(base.more["streams"]) if base else {}
    for e in deltas:
        last[e.more["stream"]] = max(e.more["batch"], last.get(e.more["stream"], -1))
    return last


def upsert_state(batch: DataFrame, batch_id: int, path: str, key: str = "question_id", stream: str = "") -> None:
    """Store a batch (``seq`` orders records of one key inside it). Batches of a stream come
    in order; one that is stored already changes nothing."""
    spark = batch.sparkSession
    log = entries(spark, path)
    if batch_id <= _stored(log).get(stream, -1):
        return
    data = new_data(path)
    dedup_last(batch, key, "seq").drop("seq").write.parquet(data)
    number = log[-1].number + 1 if log else 1
    while not commit(spark, path, number, "delta", data, stream=stream, batch=batch_id):
        number += 1


def _read(spark: SparkSession, log: Sequence[Entry], schema: str, key: str) -> DataFrame:
    base, deltas = _live(log)
    found = [e for e in [base, *deltas] if e is not None]
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[e.data for e in found])
    # one row a commit since the last base
    order = spark.createDataFrame([(e.data.rpartition("/")[2], 0 if e is base else e.number) for e in found], "__name string, __at bigint")
    name = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
    every = rows.withColumn("__name", name).join(F.broadcast(order), "__name").drop("__name")
    return dedup_last(every, key, "__at").drop("__at")


def read_run_state(spark: SparkSession, path: str, schema: str = RUN_STATE, key: str = "question_id") -> DataFrame:
    """Current record per key; no rows when nothing was stored."""
    return _read(spark, entries(spark, path), schema, key)


@dataclass
class Fold:
    """A base that is written but not yet committed."""

    path: str
    data: str
    cut: int
    streams: dict[str, int]
    built_on: int


def fold_state(spark: SparkSession, path: str, schema: str = RUN_STATE, keep: Column | None = None, key: str = "question_id") -> Fold:
    """Write all commits so far as one base, optionally only some records. ``commit_fold`` puts it
    in force; what streams store in between follows it."""
    log, data = entries(spark, path), new_data(path)
    state = _read(spark, log, schema, key)
    (state if keep is None else state.where(keep)).write.parquet(data)
    base = _base(log)
    return Fold(path, data, log[-1].number if log else 0, _stored(log), base.number if base else 0)


def commit_fold(spark: SparkSession, fold: Fold) -> None:
    """Raises Conflict if another base was committed since: fold again."""
    while True:
        log = entries(spark, fold.path)
        base = _base(log)
        if (base.number if base else 0) != fold.built_on:
            raise Conflict(f"{fold.path} was compacted by another")
        if commit(spark, fold.path, log[-1].number + 1 if log else 1, "base", fold.data, cut=fold.cut, streams=fold.streams):
            return


def compact_state(spark: SparkSession, path: str, schema: str = RUN_STATE, keep: Column | None = None) -> None:
    """Fold the deltas into a new base, optionally keeping only some records. Streams may be
    storing batches meanwhile; of two compactions the later one starts over."""
    while True:
        try:
            return commit_fold(spark, fold_state(spark, path, schema, keep))
        except Conflict:
            continue


def remove_folded(spark: SparkSession, path: str, older_than: float = 86_400.0) -> None:
    """Delete what the current base has folded, once no reader of before needs it."""
    log = entries(spark, path)
    base = _base(log)
    if base is not None:
        remove(spark, path, [e for e in log if e.number <= base.more["cut"] and e.number != base.number], older_than)


def reset_failed(spark: SparkSession, path: str, schema: str = RUN_STATE) -> None:
    """Keep what succeeded; what failed has no record and is pending again."""
    compact_state(spark, path, schema, request_succeeded("completed", "request_failed", "error"))


def stream_upserts(records: DataFrame, path: str, checkpoint: str):
    """Upsert every micro-batch of finished records; take what is there and stop.

    A stream is known by its query's id, which its checkpoint keeps: one with a new
    checkpoint is another stream.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        upsert_state(batch, batch_id, path, stream=query_id or checkpoint)

    query = (records.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(store).start())
    query.awaitTermination()
