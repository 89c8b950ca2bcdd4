"""Ratios, timings, counters and schedule arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave import constants as C
from evalweave.functions.text import col


def safe_ratio(part, whole, empty=None) -> Column:
    """Ratio with the caller's answer for a zero denominator: null or a number."""
    ratio = F.try_divide(col(part).cast("double"), col(whole).cast("double"))
    return ratio if empty is None else F.coalesce(ratio, F.lit(float(empty)))


def seconds_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def tpot(elapsed, ttft, n_tokens) -> Column:
    """Seconds per output token after the first; null unless there are at least two."""
    n = col(n_tokens)
    return F.when(n > 1, (col(elapsed) - col(ttft)) / (n - 1))


def retry_delay(attempt, base: float, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), col(attempt) - 1), F.lit(float(cap)))


def total_retry_wait(attempts, base: float, cap: float) -> Column:
    """Seconds slept before the last of ``attempts`` attempts, in closed form.

    The delays double until they reach the cap, so the sum is a geometric part
    plus a constant part.
    """
    waits = F.greatest(col(attempts) - 1, F.lit(0))
    doublings = F.greatest(F.ceil(F.log2(F.lit(float(cap)) / F.lit(base))), F.lit(0))
    growing = F.least(waits, doublings)
    return F.lit(base) * (F.pow(F.lit(2.0), growing) - 1) + (waits - growing) * F.lit(float(cap))


def log_counter(line, name: str) -> Column:
    """The count after ``name:`` in a log line, null when absent."""
    return F.regexp_extract(col(line), name + r":\s*([0-9]+)", 1).try_cast("bigint")


def valid_counts(accepted, proposed) -> Column:
    a, p = col(accepted), col(proposed)
    return F.coalesce(a <= p, F.lit(False))


def acceptance_percent(accepted, proposed) -> Column:
    """Token-weighted rate over sums; null when nothing was proposed."""
    return F.try_divide(col(accepted) * F.lit(100.0), col(proposed).cast("double"))


def usage_tokens(usage, field: str) -> Column:
    return F.get_json_object(col(usage), f"$.{field}").try_cast("bigint")


def sample_count(concurrency, multiplier=10) -> Column:
    m = F.lit(multiplier) if isinstance(multiplier, int) else col(multiplier)
    return (col(concurrency) * F.greatest(m, F.lit(1))).cast("bigint")


def auto_sample_count(concurrency, number=0) -> Column:
    """``number`` requests, or ten per slot and at least twenty when it is 0."""
    c = col(concurrency)
    n = F.lit(number) if isinstance(number, int) else col(number)
    auto = F.greatest(F.lit(C.MIN_AUTO_SAMPLES), c * C.AUTO_SAMPLES_PER_SLOT)
    return F.when(n == 0, auto).otherwise(n).cast("bigint")


def paired_sample_counts(concurrencies, numbers) -> Column:
    """Lists paired by position: array of (concurrency, number)."""
    c, n = col(concurrencies), col(numbers)
    pairs = F.zip_with(
        c, n, lambda a, b: F.struct(a.alias("concurrency"), b.alias("number"))
    )
    return F.when(F.size(c) == F.size(n), pairs)


def prefix_length(length, percent) -> Column:
    """Shared tokens of an input, null when prefix or suffix would be empty."""
    shared = F.floor(col(length) * col(percent) / 100).cast("bigint")
    return F.when((shared > 0) & (shared < col(length)), shared)


def warmup_total(requests, rounds, concurrency, case_concurrency) -> Column:
    """Explicit request count, else rounds times slots; 0 slots follow the case."""
    slots = F.greatest(
        F.coalesce(F.nullif(col(concurrency), F.lit(0)), col(case_concurrency)), F.lit(1)
    )
    return F.when(col(requests) > 0, col(requests)).otherwise(col(rounds) * slots).cast("bigint")


def wave_of(position, concurrency) -> Column:
    """1-based wave of a 0-based request position."""
    return (F.floor(col(position) / col(concurrency)) + 1).cast("bigint")


def slot_of(position, concurrency) -> Column:
    return (col(position) % col(concurrency)).cast("bigint")


def warmup_prompt(prompt, wave, slot, reuse: bool = False) -> Column:
    """Prompts are salted per wave and slot unless reuse is wanted."""
    if reuse:
        return col(prompt)
    mark = F.concat_ws(" ", F.lit("[warmup"), col(wave).cast("string"), col(slot).cast("string"))
    return F.concat(col(prompt), F.lit("\n\n"), mark, F.lit("]"))
