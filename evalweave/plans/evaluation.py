"""The steps of an evaluation run, put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.operators.aggregates import accuracy_scopes, error_categories, order_problems, summary_wide
from evalweave.operators.filters import filter_values
from evalweave.operators.joins import paired_runs
from evalweave.operators.ordering import dedup_first
from evalweave.operators.quantiles import describe

TIMINGS = ["ttft_seconds", "tpot_seconds", "elapsed_seconds", "prompt_tokens", "completion_tokens"]


def load_problems(
    bank: DataFrame, difficulties: Sequence[str] = (), limit: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(problems, counters) of a bank as ``read_problems`` gives it.

    Problems: the first row of each id with all its columns, of the wanted difficulties,
    ranked by date and id, the first ``limit`` of them (0: all). Counters: one row with rows,
    malformed and duplicates, which are the rows that are no new problem, malformed ones
    included. A bank without a usable problem is an error.
    """
    counters = bank.agg(
        F.count("*").alias("rows"), F.count_if("malformed").alias("malformed"),
        (F.count("*") - F.count_distinct(F.when(~F.col("malformed"), F.col("question_id")))).alias("duplicates"))
    first = dedup_first(bank.where("not malformed"), "question_id", "src_ord")
    wanted = filter_values(first, "difficulty", list(difficulties)) if difficulties else first
    # narrow rows are ranked, the others joined to them
    order = order_problems(wanted.select("contest_date", "question_id"), "contest_date", "question_id")
    ranked = wanted.join(order.select("question_id", "rank"), "question_id").drop("src_ord", "malformed")
    if ranked.isEmpty():
        raise ValueError("no usable problem in the bank")
    return ranked.where(F.col("rank") <= limit) if limit > 0 else ranked, counters


def parse_result(metric_rows: DataFrame, common: DataFrame, stem: str = "stem") -> DataFrame:
    """One summary row per result table that has its document: metric rows and common
    metrics of the total stage, as numbers."""
    return summary_wide(paired_runs(metric_rows, common, stem), common, stem)


def evaluation_summary(
    graded: DataFrame, records: DataFrame, scopes: Sequence[str] = ("difficulty", "platform"),
    timings: Sequence[str] = TIMINGS, error: str = "error",
) -> DataFrame:
    """A run in one table (part, name, metric, value): pass@1 of every scope, error
    categories, and all distributions, which share one pass."""
    def long(df: DataFrame, part, name: str, metrics: Sequence[str]) -> DataFrame:
        named = df.select(part.alias("part"), F.col(name).alias("name"), *[F.col(m).cast("double").alias(m) for m in metrics])
        return named.unpivot(["part", "name"], list(metrics), "metric", "value")

    accuracy = long(accuracy_scopes(graded, scopes), F.col("scope"), "name", ["passed", "total", "pass_at_1"])
    errors = long(error_categories(records, error), F.lit("errors"), "category", ["n"])
    spread = describe(records, timings).withColumnRenamed("metric", "of")
    return accuracy.unionByName(errors).unionByName(
        long(spread, F.lit("timing"), "of", ["count", "mean", "p50", "p95", "p99", "max"]))
