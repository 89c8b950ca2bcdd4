"""Warm-up schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.metrics import slot_of, warmup_prompt, wave_of
from evalweave.operators.joins import cycle_assign
from evalweave.operators.sizes import bounded
from evalweave.session import materialize


def warmup_plan(
    prompts: DataFrame, key: str, text: str, total: int, concurrency: int,
    pool: int | None = None, reuse: bool = False,
) -> DataFrame:
    """Requests in waves of ``concurrency``; prompts cycle and are salted.

    ``pool`` limits the prompts in rotation to the first ones.
    """
    usable = prompts.where(F.col(text) != "")
    if pool is not None:
        usable = usable.orderBy(key).limit(pool)
    plan = cycle_assign(materialize(usable.select(key)), key, total).select(
        "sample", key, wave_of("sample", concurrency).alias("wave"),
        slot_of("sample", concurrency).alias("slot"))
    return usable.select(key, text).join(bounded(plan, total), key).select(
        "sample", "wave", "slot", key, warmup_prompt(text, "wave", "slot", reuse).alias("prompt"))
