"""Workload matrices and build plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.cases import artifact_name
from evalweave.functions.metrics import sample_count
from evalweave.operators.joins import dataset_info, missing_artifacts
from evalweave.operators.ordering import running_total


def workload_matrix(
    types: DataFrame,
    input_lens: Sequence[int],
    concurrencies: Sequence[int],
    prefix_shares: Sequence[int | None],
    order: str = "ord",
) -> DataFrame:
    """type x length x concurrency x prefix share, numbered in nested order.

    The type table is expanded row by row with literal lists, so there is no
    cartesian join, and the sequence number is arithmetic on the type's position.
    """
    per_type = len(input_lens) * len(concurrencies) * len(prefix_shares)
    types = types.join(running_total(types.select(order), order, start="__i", total="__n"), order)

    def each(values: Sequence[int | None], kind: str):
        return F.posexplode(F.array(*[F.lit(v).cast(kind) for v in values]))

    rows = types.select("*", each(input_lens, "bigint").alias("__l", "input_len"))
    rows = rows.select("*", each(concurrencies, "bigint").alias("__c", "concurrency"))
    rows = rows.select("*", each([p or None for p in prefix_shares], "bigint").alias("__p", "pfx"))
    inner = (F.col("__l") * len(concurrencies) + F.col("__c")) * len(prefix_shares) + F.col("__p")
    return rows.withColumn("seq", (F.col("__i") * per_type + inner + 1).cast("bigint")).drop(
        "__i", "__n", "__l", "__c", "__p")


def build_plan(cases: DataFrame, manifest: DataFrame, multiplier: int = 10) -> DataFrame:
    """Matrix rows -> artefact names -> those not built yet.

    Unknown dataset types drop out; cases that share an artefact build it once.
    """
    named = dataset_info(cases).withColumn("samples", sample_count("concurrency", multiplier))
    named = named.withColumn(
        "artifact", artifact_name("artifact_prefix", "input_len", "samples", "pfx"))
    planned = named.select("dataset_type", "input_len", "samples", "pfx", "artifact").distinct()
    return missing_artifacts(planned, manifest)
