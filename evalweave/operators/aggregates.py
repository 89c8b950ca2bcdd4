"""Aggregations. Every one combines on the map side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import constants as C
from evalweave.functions.metrics import acceptance_percent, safe_ratio, seconds_between, tpot
from evalweave.functions.text import error_category, nonblank, parse_number
from evalweave.operators.ordering import as_list, null_safe_join, number_sorted
from evalweave.operators.quantiles import distribution
from evalweave.session import materialize


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _accuracy() -> list[Column]:
    return [_count_if(F.col("passed")).alias("passed"), F.count("*").alias("total")]


def _rate(df: DataFrame) -> DataFrame:
    return df.withColumn("pass_at_1", safe_ratio("passed", "total", 0))


def accuracy_by(graded: DataFrame, attribute: str) -> DataFrame:
    return _rate(graded.groupBy(F.col(attribute).alias("name")).agg(*_accuracy()))


def pass_at_1(graded: DataFrame) -> DataFrame:
    return _rate(graded.agg(*_accuracy()))


def accuracy_scopes(graded: DataFrame, scopes: Sequence[str] = ("difficulty", "platform")) -> DataFrame:
    """Overall and per attribute in one pass over the data.

    Counts are first combined per attribute tuple, so the grouping-set expansion
    multiplies the few combined rows and not the input.
    """
    scopes = list(scopes)
    combined = graded.groupBy(*scopes).agg(*_accuracy())
    sets = [[], *[[s] for s in scopes]]
    grouped = combined.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(s) for s in scopes]
    ).agg(
        F.sum("passed").alias("passed"), F.sum("total").alias("total"),
        *[F.grouping(s).alias(f"__{s}") for s in scopes],
    )
    scope, name = F.lit("overall"), F.lit("all")
    for s in scopes:
        scope = F.when(F.col(f"__{s}") == 0, F.lit(s)).otherwise(scope)
        name = F.when(F.col(f"__{s}") == 0, F.col(s)).otherwise(name)
    return _rate(grouped.select(scope.alias("scope"), name.alias("name"), "passed", "total"))


def union_scopes(graded: DataFrame, scopes: Sequence[str] = ("difficulty", "platform")) -> DataFrame:
    """The same table as a union of one aggregation per scope."""
    parts = pass_at_1(graded).select(F.lit("overall").alias("scope"), F.lit("all").alias("name"), "*")
    for s in scopes:
        parts = parts.unionByName(accuracy_by(graded, s).withColumn("scope", F.lit(s)))
    return parts


def parse_rates(graded: DataFrame) -> DataFrame:
    counts = graded.agg(
        _count_if(F.col("parsed")).alias("parsed"), _count_if(F.col("passed")).alias("passed"),
        F.count("*").alias("total"))
    return counts.select(
        "*", safe_ratio("parsed", "total", 0).alias("parsed_success_rate"),
        safe_ratio("passed", "parsed", 0).alias("pass_rate_among_parsed"))


def error_categories(records: DataFrame, error: str) -> DataFrame:
    return records.where(F.col(error) != "").groupBy(
        error_category(error).alias("category")).agg(F.count("*").alias("n"))


def acceptance_rate(counts: DataFrame, group: str | Sequence[str] = ()) -> DataFrame:
    """Token-weighted percentage over valid (accepted, proposed) rows and their
    number; null when nothing was proposed, even if n > 0."""
    valid = F.coalesce(F.col("accepted") <= F.col("proposed"), F.lit(False))
    sums = counts.groupBy(*as_list(group)).agg(
        F.sum(F.when(valid, F.col("accepted"))).alias("accepted"),
        F.sum(F.when(valid, F.col("proposed"))).alias("proposed"),
        _count_if(valid).alias("n"))
    return sums.select(*as_list(group), acceptance_percent("accepted", "proposed").alias("rate"), "n")


def summary_wide(metric_rows: DataFrame, common: DataFrame, case: str) -> DataFrame:
    """Named columns per case out of long metric rows and common metrics.

    ``metric_rows``: (case, param, average); the last row of a parameter counts
    (``ord``). ``common``: (case, metric, value). Where a side has a ``stage``, only its
    ``total`` counts; texts with units become numbers. All params are fixed names,
    so plain conditional aggregates replace a pivot.
    """
    def total(df: DataFrame, value: str) -> DataFrame:
        df = df.where(F.col("stage") == "total") if "stage" in df.columns else df
        return df.withColumn(value, parse_number(value)) if dict(df.dtypes)[value] == "string" else df

    metric_rows, common = total(metric_rows, "average"), total(common, "value")

    def pick(key: str, name: str, value: str, by: str | None) -> Column:
        hit = F.col(key) == name
        if by is None:
            return F.max(F.when(hit, F.col(value)))
        return F.max_by(F.col(value), F.when(hit, F.col(by)))

    params = metric_rows.groupBy(case).agg(
        *[pick("param", p, "average", "ord").alias(c) for c, p in C.SUMMARY_PARAMS.items()])
    commons = common.groupBy(case).agg(
        *[pick("metric", m, "value", None).alias(c) for c, m in C.SUMMARY_COMMON.items()])
    return params.join(commons, case, "left")


def load_rollup(requests: DataFrame, group: str = "concurrency") -> DataFrame:
    """Counts, throughput and means per concurrency. Throughput is over the span
    from the first start to the last finish; means are over successful requests.

    Needs ok, start, elapsed_seconds, ttft_seconds, input_tokens, output_tokens.
    """
    ok = F.col("ok")
    finish = F.col("start") + F.make_dt_interval(secs=F.col("elapsed_seconds").cast("decimal(18,6)"))
    # the numbers are worked out once, and read by the sums and both passes of the percentiles
    rows = materialize(requests.select(
        group, "ok", "start", "elapsed_seconds", "ttft_seconds", "input_tokens", "output_tokens", finish.alias("__finish"),
        tpot("elapsed_seconds", "ttft_seconds", "output_tokens").alias("__tpot")))

    def good(c: str) -> Column:
        return F.when(ok, F.col(c))

    sums = rows.groupBy(group).agg(
        F.count("*").alias("requests"), _count_if(ok).alias("succeed"), _count_if(~ok).alias("failed"),
        F.min("start").alias("__a"), F.max("__finish").alias("__b"),
        F.sum(good("output_tokens")).alias("__out"),
        F.sum(good("input_tokens")).alias("__in"),
        F.sum(F.when(ok, F.greatest(F.col("output_tokens") - 1, F.lit(0)))).alias("__gaps"),
        F.sum(F.when(ok & (F.col("output_tokens") > 1),
                     F.col("elapsed_seconds") - F.col("ttft_seconds"))).alias("__gap_seconds"),
        F.avg(good("elapsed_seconds")).alias("avg_latency_s"),
        F.avg(good("ttft_seconds")).alias("avg_ttft_s"),
        F.avg(good("__tpot")).alias("avg_tpot_s"),
        F.avg(good("input_tokens")).alias("avg_input_tokens"),
        F.avg(good("output_tokens")).alias("avg_output_tokens"),
    )
    span = seconds_between("__a", "__b")
    means = sums.select(
        group, "requests", "succeed", "failed",
        safe_ratio(F.col("succeed"), span).alias("request_throughput"),
        safe_ratio(F.col("__out"), span).alias("output_token_throughput"),
        safe_ratio(F.col("__out") + F.col("__in"), span).alias("total_token_throughput"),
        "avg_latency_s", "avg_ttft_s", "avg_tpot_s",
        safe_ratio("__gap_seconds", "__gaps").alias("avg_itl_s"),
        "avg_input_tokens", "avg_output_tokens",
    )
    long = rows.select(
        group,
        good("elapsed_seconds").alias("p99_latency_s"), good("ttft_seconds").alias("p99_ttft_s"),
        good("__tpot").alias("p99_tpot_s"),
    ).unpivot([group], ["p99_latency_s", "p99_ttft_s", "p99_tpot_s"], "metric", "value")
    p99 = distribution(long, "value", {"p99": 0.99}, [group, "metric"])
    wide = p99.groupBy(group).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("p99"))).alias(m)
        for m in ("p99_latency_s", "p99_ttft_s", "p99_tpot_s")])
    return null_safe_join(means, wide, [group], "left")


def micro_macro(graded: DataFrame, subset: str) -> DataFrame:
    """Sample-weighted score, unweighted mean over subsets, total samples."""
    by_subset = _rate(graded.groupBy(subset).agg(*_accuracy()))
    return combine_scores(by_subset.select(F.col("total").alias("num"), F.col("pass_at_1").alias("score")))


def combine_scores(subsets: DataFrame, group: str | Sequence[str] = ()) -> DataFrame:
    """(num, score) rows -> weighted score, macro score, total num."""
    sums = subsets.groupBy(*as_list(group)).agg(
        F.sum(F.col("num") * F.col("score")).alias("__w"), F.sum("num").alias("num"),
        F.avg("score").alias("macro_score"), F.count("*").alias("subsets"))
    return sums.select(
        *as_list(group), safe_ratio("__w", "num", 0).alias("score"),
        F.coalesce("macro_score", F.lit(0.0)).alias("macro_score"),
        F.coalesce("num", F.lit(0)).alias("num"), "subsets")


def wave_stats(requests: DataFrame, keys: str | Sequence[str], order: str) -> DataFrame:
    """Per wave: successes, mean seconds over them, mean time to first token
    (0 if none), failures and the last non-empty error."""
    ok = F.col("ok")
    bad = ~ok & (F.coalesce(F.col("error"), F.lit("")) != "")
    return requests.groupBy(*as_list(keys)).agg(
        _count_if(ok).alias("ok"), F.count("*").alias("total"),
        F.avg(F.when(ok, F.col("elapsed_seconds"))).alias("avg_seconds"),
        F.coalesce(F.avg(F.when(ok, F.col("ttft_seconds"))), F.lit(0.0)).alias("avg_ttft"),
        _count_if(~ok).alias("failed"),
        F.max_by(F.col("error"), F.when(bad, F.col(order))).alias("last_error"))


def cold_warm_ratio(waves: DataFrame, group: str | Sequence[str], wave: str = "wave") -> DataFrame:
    """First over last wave mean, among waves with a success; null unless there
    are two of them and the numbers mean something."""
    good = F.when(F.col("ok") > 0, F.col(wave))
    ends = waves.groupBy(*as_list(group)).agg(
        F.min_by("avg_seconds", good).alias("first_avg"),
        F.max_by("avg_seconds", good).alias("last_avg"),
        F.count(good).alias("good_waves"))
    usable = (F.col("good_waves") >= 2) & (F.col("last_avg") > 0) & (
        F.col("first_avg") >= C.MIN_COLD_SECONDS)
    return ends.withColumn("ratio", F.when(usable, safe_ratio("first_avg", "last_avg")))


def completeness(records: DataFrame, key: Column, malformed: Column) -> DataFrame:
    """Rows, unique ids and duplicates; malformed rows count as duplicates."""
    return records.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.when(~malformed, key)).alias("unique"),
        _count_if(F.col("completed")).alias("completed"),
        _count_if(nonblank("content")).alias("nonempty"),
        _count_if(F.col("parsed")).alias("parsed"),
    ).withColumn("duplicate_ids", F.col("rows") - F.col("unique"))


def request_timing(chunks: DataFrame, key: str, order: str, started: str | None = None) -> DataFrame:
    """Time to first token, elapsed seconds, chunk count, last finish reason and
    usage per request; a response without a token is an error.

    ``chunks``: key, ts, piece, finish_reason, usage and a unique ``order``. ``started``
    names the column with the time the request was sent (the earliest counts); without
    it, times run from the first chunk and leave out the wait before it.
    """
    has_text = F.coalesce(F.col("piece"), F.lit("")) != ""
    timing = chunks.groupBy(key).agg(
        F.min(started or "ts").alias("__start"), F.min(F.when(has_text, F.col("ts"))).alias("__first"),
        F.max("ts").alias("__end"), _count_if(has_text).alias("chunks"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col(order))).alias("finish_reason"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col(order))).alias("usage"))
    return timing.select(
        key, seconds_between("__start", "__first").alias("ttft_seconds"),
        seconds_between("__start", "__end").alias("elapsed_seconds"),
        "chunks", "finish_reason", "usage",
        F.when(F.col("chunks") == 0, F.lit("empty_response")).alias("error"))


def before_done(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Drop what follows the end mark of a response, and the mark itself."""
    ends = chunks.where("done").groupBy(key).agg(F.min(order).alias("__end"))
    return chunks.join(ends, key, "left").where(
        F.col("__end").isNull() | (F.col(order) < F.col("__end"))).drop("__end")


def length_audit(samples: DataFrame, length: int, corpus: DataFrame) -> DataFrame:
    """Samples that hit the length, and whether the corpus was used up."""
    size = corpus.agg(F.count("*").alias("n")).scalar()
    return samples.agg(
        F.count("*").alias("samples"), _count_if(F.col("n_tokens") == length).alias("exact"),
        F.sum("draws").alias("draws"),
    ).withColumn("reused", F.col("draws") > size)


def active_types(cases: DataFrame) -> DataFrame:
    return cases.select("dataset_type").distinct().orderBy("dataset_type")


def group_results(cases: DataFrame) -> DataFrame:
    """Counts by status per (type, length, prefix); no prefix is its own group."""
    ok = F.col("status") == "ok"
    return cases.groupBy("dataset_type", "input_len", "pfx").agg(
        F.count("*").alias("cases"), _count_if(ok).alias("ok"), _count_if(~ok).alias("failed"))


def order_problems(problems: DataFrame, date: str, key: str) -> DataFrame:
    return number_sorted(problems.select(key, date), [date, key])


def order_case_keys(keys: DataFrame, key: str) -> DataFrame:
    """Number-like text order: shorter first, then by text."""
    return number_sorted(keys.select(key), [F.length(key), F.col(key)])


def order_by_concurrency(rows: DataFrame, concurrency: str, key: str) -> DataFrame:
    return number_sorted(
        rows.select(key, concurrency), [F.coalesce(F.col(concurrency), F.lit(0)), F.col(key)])


def order_scopes(rows: DataFrame, domain: Sequence[str] = C.DIFFICULTIES) -> DataFrame:
    """Overall, then difficulties in domain order, then the other scopes by name."""
    place = F.array_position(F.array(*[F.lit(d) for d in domain]), F.col("name"))
    scope = F.when(F.col("scope") == "overall", 0).when(F.col("scope") == "difficulty", 1).otherwise(2)
    return number_sorted(rows, [
        scope, F.when(F.col("scope") == "difficulty", place).otherwise(0), F.col("scope"), F.col("name")])
