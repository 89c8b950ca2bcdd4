"""Broadcast hints behind a size check.

The optimizer learns the size of a derived table only once it is computed, and by
then the other side may already be on its way through a shuffle. Where one side is
often tiny and the other is the corpus, the size is established first: from a row
bound the caller can prove, or by computing the narrow side once and measuring it.
Beyond the limit the join stays an ordinary shuffled one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialize

BROADCAST_BYTES = 64 << 20
FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
CELL_BYTES = 16


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` has at most ``rows`` rows; broadcast it if they surely fit."""
    if all(kind in FIXED for _, kind in df.dtypes):
        return F.broadcast(df) if rows * CELL_BYTES * len(df.columns) <= BROADCAST_BYTES else df
    return measured(df)


def measured(df: DataFrame) -> DataFrame:
    """Compute a narrow ``df`` once, and broadcast it if what came out fits."""
    kept = materialize(df)
    wide = [F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(name)))), F.lit(0))
            for name, kind in kept.dtypes if kind not in FIXED]
    size = F.count("*") * CELL_BYTES * len(kept.columns)
    for w in wide:
        size = size + w
    return F.broadcast(kept) if kept.agg(size).first()[0] <= BROADCAST_BYTES else kept
