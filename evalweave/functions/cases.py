"""Workload cases and artefact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import constants as C
from evalweave.functions.text import col, strip


def artifact_name(prefix, input_len, samples, pfx) -> Column:
    """``{prefix}{len}-bs{n}[-pfx{p}].jsonl``; a prefix share of 0 is none."""
    p = col(pfx).cast("string")
    tag = F.when(col(pfx) != 0, F.concat(F.lit("-pfx"), p)).otherwise(F.lit(""))
    return F.concat(
        col(prefix), col(input_len).cast("string"), F.lit("-bs"),
        col(samples).cast("string"), tag, F.lit(".jsonl"),
    )


def case_name(artifact, concurrency) -> Column:
    stem = F.regexp_replace(col(artifact), r"\.jsonl$", "")
    return F.concat(stem, F.lit("-"), col(concurrency).cast("string"), F.lit("并发"))


def dataset_prefix(dataset_type) -> Column:
    """Artefact prefix of a known dataset type, else null."""
    known = F.create_map(*[F.lit(x) for t, (_, p) in C.DATASETS.items() for x in (t, p)])
    return F.try_element_at(known, col(dataset_type))


def parse_cases(df: DataFrame, text: str, case: str = "case") -> DataFrame:
    """Add ``[type:]in-out-concurrency-rate[-pfx]`` as a struct with a reject reason.

    The steps are separate projections, so that the text is split once per row.
    """
    raw = strip(text)
    kind = F.lower(F.substring_index(raw, ":", 1))
    named = (F.instr(raw, ":") > 0) & kind.isin(*C.DATASETS)
    df = df.withColumn("__kind", F.when(named, kind).otherwise(F.lit(C.DEFAULT_DATASET)))
    rest = F.when(named, F.substring(raw, F.instr(raw, ":") + 1, F.length(raw))).otherwise(raw)
    df = df.withColumn("__parts", F.split(rest, "-"))
    part = [F.get("__parts", F.lit(i)) for i in range(5)]
    kinds = ["bigint", "bigint", "bigint", "double", "bigint"]
    df = df.withColumn("__v", F.struct(*[p.try_cast(k).alias(f"v{i}") for i, (p, k) in enumerate(zip(part, kinds))]))
    v = [F.col(f"__v.v{i}") for i in range(5)]
    n = F.size("__parts")
    reason = (
        F.when(F.col(text).isNull() | (n < 4), F.lit("too few fields"))
        .when(F.greatest(*[x.isNull() for x in v[:4]]), F.lit("bad number"))
        .when((n >= 5) & v[4].isNull(), F.lit("bad prefix share"))
    )
    return df.withColumn(case, F.struct(
        F.col("__kind").alias("dataset_type"), v[0].alias("input_len"), v[1].alias("out_len"),
        v[2].alias("concurrency"), v[3].alias("request_rate"),
        F.nullif(v[4], F.lit(0).cast("bigint")).alias("pfx"), reason.alias("reject_reason"),
    )).drop("__kind", "__parts", "__v")


def case_from_object(raw: Column | str, seq) -> Column:
    """The same struct from an object (variant) with alternative field names."""
    v = col(raw)

    def pick(kind: str, *names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])

    input_len = pick("bigint", "in", "input_len")
    out_len = pick("bigint", "out", "out_len")
    return F.struct(
        F.coalesce(pick("string", "seq", "id"), col(seq).cast("string")).alias("seq"),
        F.coalesce(pick("string", "dataset_type", "ds"), F.lit(C.DEFAULT_DATASET)).alias("dataset_type"),
        input_len.alias("input_len"),
        out_len.alias("out_len"),
        F.coalesce(pick("bigint", "concurrency", "c"), F.lit(0)).alias("concurrency"),
        F.coalesce(pick("double", "rate", "request_rate"), F.lit(0.0)).alias("request_rate"),
        pick("bigint", "pfx").alias("pfx"),
        F.when(input_len.isNull() | out_len.isNull(), F.lit("bad number")).alias("reject_reason"),
    )
