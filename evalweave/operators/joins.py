"""Joins. Sizes are left to the optimizer, which checks them at run time and splits
skewed partitions; where one side is small by nature it is measured first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave import constants as C
from evalweave.functions.cases import dataset_prefix
from evalweave.operators.ordering import integer_ordered, null_safe_join, running_total
from evalweave.operators.sizes import measured


def pending(problems: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Problems without a completed record."""
    done = state.where(F.coalesce(F.col("completed"), F.lit(False))).select(key)
    return problems.join(done, key, "left_anti")


def attach_state(problems: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Every problem with its parsed code, empty when there is none."""
    one = state.groupBy(key).agg(F.max("parsed_code").alias("parsed_code"))  # repeated records multiply nothing
    joined = problems.join(one, key, "left")
    return joined.withColumn("parsed_code", F.coalesce("parsed_code", F.lit("")))


def attach_grade(problems: DataFrame, grades: DataFrame, key: str) -> DataFrame:
    """Every problem with its grade; an ungraded problem did not pass."""
    one = grades.groupBy(key).agg(F.max("passed").alias("passed"))
    joined = problems.join(one, key, "left")
    return joined.withColumn("passed", F.coalesce("passed", F.lit(False)))


def attach_p99(summaries: DataFrame, percentiles: DataFrame) -> DataFrame:
    """Run summaries with the first 99% row of the same run directory."""
    row = percentiles.where(F.col("percentile") == C.PERCENTILE_ROW).drop("percentile")
    rest = [c for c in row.columns if c != "run_dir"]
    one = row.groupBy("run_dir").agg(F.first(F.struct(*rest)).alias("__row")).select("run_dir", "__row.*")
    return summaries.join(one, "run_dir", "left")


def paired_runs(tables: DataFrame, documents: DataFrame, stem: str = "stem") -> DataFrame:
    """Result tables that have a document with the same stem."""
    return tables.join(documents.select(stem), stem, "left_semi")


def from_offset(records: DataFrame, offsets: DataFrame, path: str, pos: str) -> DataFrame:
    """Records at or after the stored offset of their file.

    ``offsets`` has (path, offset, size); a file now shorter than its offset was
    truncated and counts from 0. A file without an offset is read whole. There is
    one offset per file, so the records of a large log need not be shuffled.
    """
    start = F.when(F.col("size") >= F.col("offset"), F.col("offset")).otherwise(0)
    starts = measured(offsets.select(path, start.alias("__start")))
    return (
        records.join(starts, path, "left")
        .where(F.col(pos) >= F.coalesce("__start", F.lit(0)))
        .drop("__start")
    )


def missing_artifacts(planned: DataFrame, manifest: DataFrame, name: str = "artifact") -> DataFrame:
    return planned.join(manifest.select(name), name, "left_anti")


#: Rows of one key that a join leaves to one task.
SLICE = 1 << 16


def spread_join(many: DataFrame, few: DataFrame, on: str, row: str) -> DataFrame:
    """Inner join on ``on`` where a few keys may carry most rows of ``many``.

    A key with more than ``SLICE`` rows is cut into slices by a hash of ``row``, and its rows of
    ``few`` are copied once a slice. ``many`` is read twice: pass computed, narrow rows.
    """
    slices = F.ceil(F.count("*") / SLICE).cast("int")
    heavy = measured(many.groupBy(on).agg(slices.alias("__slices")).where("__slices > 1"))
    if heavy.isEmpty():
        return many.join(few, on)
    cut = many.join(heavy, on, "left").withColumn(
        "__slice", F.pmod(F.xxhash64(row), F.coalesce("__slices", F.lit(1)))).drop("__slices")
    copies = few.join(heavy, on, "left").withColumn("__slice", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.coalesce("__slices", F.lit(1)).cast("bigint") - 1))).drop("__slices")
    return cut.join(copies, [on, "__slice"]).drop("__slice")


CYCLE_BLOCK = 4096


def cycle_assign(corpus: DataFrame, key: str, n_samples: int, spread: bool = False) -> DataFrame:
    """(sample, key): sample i uses corpus item ``i mod n`` in key order.

    Only keys are numbered and repeated; join the texts afterwards. A corpus at
    least as large as the sample count is not repeated at all. Where a few items make many
    samples, ``spread`` deals the blocks of repetitions out before they are written out.
    """
    keys, by = integer_ordered(corpus.select(key), key)
    placed = running_total(keys, by, start="__i", total="__n")
    used = placed.where(F.col("__i") < n_samples)
    last = F.floor((F.lit(n_samples) - 1 - F.col("__i")) / F.col("__n")).cast("bigint")
    # two steps, so that a tiny corpus does not build one array per repetition
    blocks = used.select("*", last.alias("__last"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), last, F.lit(CYCLE_BLOCK).cast("bigint"))).alias("__block"))
    blocks = blocks.repartition("__i", "__block") if spread else blocks
    cycles = blocks.select(key, "__i", "__n", F.explode(F.sequence(
        F.col("__block"), F.least(F.col("__block") + CYCLE_BLOCK - 1, F.col("__last")))).alias("__cycle"))
    return cycles.select((F.col("__cycle") * F.col("__n") + F.col("__i")).alias("sample"), key)


def dataset_info(rows: DataFrame) -> DataFrame:
    """Known dataset types with display name and artefact prefix; a three-entry
    lookup, so no join."""
    names = F.create_map(*[F.lit(x) for t, (n, _) in C.DATASETS.items() for x in (t, n)])
    return rows.select(
        "*", F.try_element_at(names, F.col("dataset_type")).alias("display_name"),
        dataset_prefix("dataset_type").alias("artifact_prefix"),
    ).where(F.col("artifact_prefix").isNotNull())


def unknown_datasets(rows: DataFrame) -> DataFrame:
    return rows.where(dataset_prefix("dataset_type").isNull())


def reconcile_counts(expected: DataFrame, observed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Expected and observed counts per case, with a mismatch flag; (.., n) each."""
    a = expected.withColumnRenamed("n", "expected")
    b = observed.withColumnRenamed("n", "observed")
    return a.join(b, on, "full").withColumn(
        "mismatch", ~F.col("expected").eqNullSafe(F.col("observed")))


__all__ = [
    "attach_grade", "attach_p99", "attach_state", "cycle_assign", "dataset_info",
    "from_offset", "missing_artifacts", "null_safe_join", "paired_runs", "pending",
    "reconcile_counts", "spread_join", "unknown_datasets",
]
