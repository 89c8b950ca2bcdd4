"""Exact quantiles without gathering a group's values in one task.

A first pass counts values per logarithmic bucket (map-side combined, about ten
thousand buckets per decade). The buckets that hold the wanted ranks are found from
those counts alone; a second pass counts the distinct values of only these buckets.
They are ranked in slices between the bucket's own minimum and maximum, so that no
window holds more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.operators.ordering import as_list, null_safe_join, sum_before
from evalweave.operators.sizes import measured

BUCKETS_PER_E = 4096
SLICES = 65536


def _bucket(x: Column) -> Column:
    """A non-decreasing integer function of the value."""
    size = F.least(F.abs(x), F.lit(1e290)) * F.lit(1e6)
    return F.floor(F.signum(x) * F.log1p(size) * F.lit(BUCKETS_PER_E)).cast("bigint")


def distribution(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    group: str | Sequence[str] = (),
) -> DataFrame:
    """Per group: count, mean, min, max and linearly interpolated quantiles.

    Null and NaN values are skipped; a group without values keeps a row with
    count 0 and null statistics. ``probs`` maps output names to probabilities.
    """
    group = as_list(group)
    x = F.col(value).cast("double")
    values = df.select(*group, F.when(~F.isnan(x), x).alias("__x")).withColumn("__b", _bucket(F.col("__x")))
    buckets = values.groupBy(*group, "__b").agg(
        F.count("__x").alias("__n"), F.sum("__x").alias("__s"),
        F.min("__x").alias("__lo"), F.max("__x").alias("__hi"),
    )
    whole = W.partitionBy(*group)
    before = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.select(
        *group, "__b", "__n",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"), "__lo", "__hi",
        F.sum("__n").over(whole).alias("count"),
        F.sum("__s").over(whole).alias("__sum"),
        F.min("__lo").over(whole).alias("min"),
        F.max("__hi").over(whole).alias("max"),
    )
    last = F.col("count") - 1
    low = {p: F.floor(last * F.lit(p)).cast("bigint") for p in probs.values()}
    ranks = F.array_distinct(F.array(*[r for lo in low.values() for r in (lo, F.least(lo + 1, last))]))
    summary = ["count", "__sum", "min", "max"]
    wanted = placed.withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__from")) & (
        r < F.col("__from") + F.col("__n"))))
    empty = F.col("count") == 0
    kept = measured(wanted.where((F.size("__ranks") > 0) | empty).select(
        *group, "__b", "__from", "__lo", "__hi", "__ranks", *summary))
    hits = kept.where(~empty)

    # second pass: distinct values of the hit buckets with their ranks
    found = null_safe_join(
        values.where(F.col("__x").isNotNull()), hits.select(*group, "__b"), [*group, "__b"], "left_semi")
    counted = null_safe_join(
        found.groupBy(*group, "__b", "__x").agg(F.count("*").alias("__c")), hits, [*group, "__b"])
    share = F.try_divide(F.col("__x") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    counted = counted.withColumn("__slice", F.floor(F.coalesce(share, F.lit(0.0)) * SLICES).cast("bigint"))
    slices = counted.groupBy(*group, "__b", "__slice").agg(F.sum("__c").alias("__in_slice"))
    slices = slices.select(*group, "__b", "__slice", sum_before("__in_slice", [*group, "__b"], "__slice").alias("__to_slice"))
    per_value = null_safe_join(counted, slices, [*group, "__b", "__slice"]).withColumn(
        "__from", F.col("__from") + F.col("__to_slice") + sum_before("__c", [*group, "__b", "__slice"], "__x"))
    held = F.filter("__ranks", lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__c")))
    at_rank = per_value.select(*group, "__x", *summary, F.explode(held).alias("__rank"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(F.col("__rank") == rank, F.col("__x")))

    picks = []
    for name, p in probs.items():
        lo = low[p]
        picks += [value_at(lo).alias(f"__{name}_lo"), value_at(F.least(lo + 1, last)).alias(f"__{name}_hi")]
    stats = at_rank.groupBy(*group, *summary).agg(*picks)

    def interpolate(name: str, p: float) -> Column:
        part = last * F.lit(p) - low[p]
        return F.col(f"__{name}_lo") * (1 - part) + F.col(f"__{name}_hi") * part

    full = stats.select(
        *group, "count", (F.col("__sum") / F.col("count")).alias("mean"), "min", "max",
        *[interpolate(n, p).alias(n) for n, p in probs.items()],
    )
    none = kept.where(empty).select(
        *group, "count", *[F.lit(None).cast("double").alias(c) for c in ("mean", "min", "max", *probs)])
    return full.unionByName(none)


def describe(df: DataFrame, metrics: Sequence[str], group: str | Sequence[str] = ()) -> DataFrame:
    """count, mean, p50, p95, p99, max of several numeric columns, one row each."""
    group = as_list(group)
    long = df.select(*group, *[F.col(m).cast("double") for m in metrics]).unpivot(
        group, list(metrics), "metric", "value")
    stats = distribution(long, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, [*group, "metric"])
    return stats.select(*group, "metric", "count", "mean", "p50", "p95", "p99", "max")


def metric_stats(df: DataFrame, param: str, stage: str, value: str) -> DataFrame:
    """Average, Min, Max, Median, P75, P90, P99, N per (parameter, stage)."""
    stats = distribution(
        df, value, {"median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}, [param, stage])
    return stats.select(
        F.col(param).alias("param"), F.col(stage).alias("stage"), F.col("mean").alias("average"),
        "min", "max", "median", "p75", "p90", "p99", F.col("count").alias("n"))


#: Size of a sketch: its rank error is about 2.3 / k ** 0.97, here 0.14 %; ``RANK_ERROR`` bounds
#: it with room to spare. A sketch takes some tens of kilobytes, whatever it has seen.
SKETCH_K, RANK_ERROR = 2048, 0.005


def sketch(df: DataFrame, metrics: Sequence[str], group: str | Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(group, metric, count, sum, min, max, sketch): what ``describe`` needs of several
    numeric columns, in one pass and mergeable, to be stored per run. Null and NaN are skipped."""
    group = as_list(group)
    long = df.select(*group, *[F.col(m).cast("double") for m in metrics]).unpivot(group, list(metrics), "metric", "value")
    x = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy(*group, "metric").agg(
        F.count(x).alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merge_sketches(stored: DataFrame, group: str | Sequence[str] = ()) -> DataFrame:
    """One row per group and metric of the stored rows of many runs."""
    return stored.groupBy(*as_list(group), "metric").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def described(stored: DataFrame, group: str | Sequence[str] = ()) -> DataFrame:
    """``describe`` of what the sketches have seen: percentiles within ``RANK_ERROR`` of their rank."""
    def at(p: float) -> Column:
        return F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))

    return stored.select(*as_list(group), "metric", "count", F.try_divide("sum", "count").alias("mean"),
                         at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "max")
