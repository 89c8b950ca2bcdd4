"""Acceptance rate over a log that is still being written."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalweave.operators.aggregates import acceptance_rate
from evalweave.sinks.tables import read_table, replace_table
from evalweave.sources.logs import acceptance_counts

RESULT = "rate double, n bigint"


def stream_acceptance(lines: DataFrame, line: str = "line") -> DataFrame:
    """Running sums over new log lines; the only state is one row."""
    return acceptance_rate(acceptance_counts(lines, line))


def run_available(lines: DataFrame, checkpoint: str, target: str) -> None:
    """Take in what is there, replace the result table, and stop. The checkpoint
    remembers how far each file was read."""
    def store(batch: DataFrame, _: int) -> None:
        replace_table(batch, target)

    (stream_acceptance(lines).writeStream.outputMode("complete")
     .option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .foreachBatch(store).start().awaitTermination())


def drain_until(
    spark: SparkSession, lines: DataFrame, checkpoint: str, target: str,
    expected: int | None = None, max_wait: float = 0.0, settle: float = 0.0,
    sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic,
) -> tuple[float | None, int]:
    """Rounds of ``run_available`` until ``expected`` records were seen or time is
    up. A different count is reported, not repaired."""
    deadline = clock() + max_wait
    if settle > 0:
        sleep(min(settle, max_wait))
    while True:
        run_available(lines, checkpoint, target)
        row = read_table(spark, target, RESULT).first()
        rate, n = (row.rate, row.n) if row else (None, 0)
        left = deadline - clock()
        if expected is None or n >= expected or left <= 0:
            break
        sleep(min(0.5, left))
    if expected is not None and n != expected:
        warnings.warn(f"{n} valid records instead of {expected}", stacklevel=2)
    return rate, n
