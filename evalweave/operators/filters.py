"""Row filters and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.metrics import valid_counts
from evalweave.functions.text import nonblank
from evalweave.operators.ordering import running_total
from evalweave.operators.sizes import measured


def filter_role(turns: DataFrame, role: str, human: str) -> DataFrame:
    """``human`` keeps the human turns, ``all`` every turn."""
    if role not in ("human", "all"):
        raise ValueError(f"role must be human or all: {role!r}")
    return turns.where(F.col("role") == human) if role == "human" else turns


def filter_nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.where(nonblank(column))


drop_empty_docs = filter_nonblank
"""A text has no token exactly when it is blank; no need to tokenize for it."""


def valid_multiturn(turns: DataFrame, human: str, limit: int = 0) -> DataFrame:
    """Ids of chats with at least two turns, an even count and a human start;
    the first ``limit`` by id, 0 for all."""
    chats = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.min_by("role", "turn").alias("first_role"))
    valid = chats.where(
        (F.col("n_turns") >= 2) & (F.col("n_turns") % 2 == 0) & (F.col("first_role") == human)
    ).select("conv_id")
    return valid.orderBy("conv_id").limit(limit) if limit > 0 else valid


def filter_values(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Case-insensitive membership; no wanted values keeps all rows."""
    if not wanted:
        return df
    return df.where(F.lower(column).isin([w.lower() for w in wanted]))


def filter_subset(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``wanted.name``. A short list is broadcast, so
    that a subset with most of the rows stays where it is."""
    names = measured(wanted.select(F.col("name").alias(column)).distinct())
    return df.join(names, column, "left_semi")


def unknown_names(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Requested names that do not occur in the data."""
    return wanted.join(df.select(F.col(column).alias("name")).distinct(), "name", "left_anti")


def filter_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Exact id set as a semi-join; the id table may be of any size."""
    return df.join(measured(ids.select(key)), key, "left_semi")


def filter_valid_counts(df: DataFrame, accepted: str, proposed: str) -> DataFrame:
    return df.where(valid_counts(accepted, proposed))


def request_succeeded(completed, request_failed, error) -> Column:
    """A legacy record has no failure flag: then its error must be empty or
    ``code_parse_error``."""
    text = F.coalesce(F.col(error), F.lit(""))
    legacy_ok = text.isin("", "code_parse_error")
    return F.coalesce(F.col(completed), F.lit(False)) & F.coalesce(~F.col(request_failed), legacy_ok)


def split_status(df: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(status), F.lit(False))
    return df.where(ok), df.where(~ok)


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks, in given order.

    A rule that evaluates to null counts as broken.
    """
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*named)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.size("violations") == 0
    return checked.where(good).drop("violations"), checked.where(~good)


def whole_number(column: str, minimum: int = 0) -> Column:
    """Rule: a value of a whole-number text or column, at least ``minimum``."""
    return F.col(column).try_cast("string").rlike(r"^\s*[+-]?\d+\s*$") & (
        F.col(column).try_cast("bigint") >= minimum)


def mark_outcome(content: str, code: str) -> Column:
    """Why a finished request has no code: nothing came, or nothing parsed."""
    return F.when(~nonblank(content), F.lit("empty_content")).when(
        ~nonblank(code), F.lit("code_parse_error"))


def head_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows in order after filtering; 0 or less keeps all."""
    return df.orderBy(*order).limit(n) if n > 0 else df


def check_parseable(bank: DataFrame) -> DataFrame:
    """One row (rows, error) for a problem bank with its ``malformed`` flag and
    ``line_no``: it needs a row, and its first row must parse."""
    return bank.agg(
        F.count("*").alias("rows"), F.min_by("malformed", "line_no").alias("bad")
    ).select("rows", F.when(F.col("rows") == 0, F.lit("empty")).when(
        F.col("bad"), F.lit("unparseable")).alias("error"))


def first_n_positions(df: DataFrame, order: str, n: int) -> DataFrame:
    """First ``n`` rows by a unique integer key, for an ``n`` too large to gather."""
    return running_total(df.select(order), order).where(F.col("start") < n).select(order)
