"""Token, number and name functions: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def tokens(text) -> Column:
    """Whitespace words, the default tokenizer."""
    return F.array_remove(F.split(col(text), r"\s+"), "")


def token_count(text) -> Column:
    return F.size(tokens(text)).cast("bigint")


def nonblank(text) -> Column:
    """True for text with at least one visible character; null counts as blank."""
    return F.coalesce(col(text).rlike(r"\S"), F.lit(False))


def first_tokens(text, length) -> Column:
    """The first ``length`` tokens; splitting stops there, whatever the text's size.

    Two more pieces than tokens: one for a leading blank, one for the rest.
    """
    n = _int(length)
    return F.slice(F.array_remove(F.split(col(text), r"\s+", n + 2), ""), F.lit(1), n)


def truncate_tokens(text, length) -> Column:
    return F.array_join(first_tokens(text, length), " ")


def tile_tokens(text, length) -> Column:
    """Repeat the tokens up to exactly ``length``; null when there is none."""
    toks, n = first_tokens(text, length), _int(length)
    times = F.ceil(n / F.size(toks)).cast("int")
    tiled = F.slice(F.flatten(F.array_repeat(toks, times)), F.lit(1), n)
    return F.when(F.size(toks) == n, F.array_join(toks, " ")).when(
        F.size(toks) > 0, F.array_join(tiled, " "))


def approx_tokens(text) -> Column:
    """Budget estimate: a token per four characters, at least one."""
    return F.greatest(F.floor(F.length(col(text)) / 4), F.lit(1)).cast("bigint")


def parse_number(text) -> Column:
    """First decimal number inside a text with units, else null."""
    return F.regexp_extract(col(text), C.NUMBER_PATTERN, 0).try_cast("double")


def clean_text(text) -> Column:
    """Drop control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(col(text), C.CONTROL_PATTERN, "")


def safe_name(name) -> Column:
    marks = "_" * len(C.ILLEGAL_NAME_CHARS)
    return F.left(
        F.translate(col(name), C.ILLEGAL_NAME_CHARS, marks), F.lit(C.SHEET_NAME_LENGTH)
    )


def _plain(number: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(number.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def format_rate(rate) -> Column:
    """``na`` for null, whole numbers without a point, else six significant digits."""
    x = col(rate).cast("double")
    size = F.abs(x)
    # round() wants a literal scale, so one branch per magnitude
    plain = reduce(
        lambda acc, e: acc.when(size < 10.0 ** (e + 1), _plain(F.round(x, 5 - e))),
        range(-3, 6),
        F.when(size < 1e-3, _plain(F.round(x, 9))),
    )
    power = F.floor(F.log10(size))
    mantissa = F.round(x / F.pow(F.lit(10.0), power), 5)
    power = F.when(F.abs(mantissa) >= 10, power + 1).otherwise(power)
    mantissa = F.when(F.abs(mantissa) >= 10, mantissa / 10).otherwise(mantissa)
    exponent = F.concat(
        _plain(mantissa), F.lit("e"),
        F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return (
        F.when(x.isNull(), F.lit("na"))
        .when(x == F.floor(x), F.floor(x).cast("string"))
        # the limits 1e-4 and 1e6 hold for the rounded number
        .when((size < 9.999995e-5) | (size >= 999999.5), exponent)
        .otherwise(plain)
    )


def remove_until(text, marker: str = C.THINK_END) -> Column:
    """What follows the last ``marker``; unchanged without one."""
    return F.split_part(col(text), F.lit(marker), F.lit(-1))


def error_category(error) -> Column:
    return F.substring_index(col(error), ":", 1)


def extract_code(reply) -> Column:
    """Body of the last fenced block, empty when the reply has none."""
    blocks = F.regexp_extract_all(col(reply), F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.lit(""))


def join_name_path(names) -> Column:
    return F.array_join(col(names), "/")


def split_list(text) -> Column:
    """Comma or blank separated words, without blanks, first mention kept."""
    return F.array_distinct(F.array_remove(F.split(col(text), r"[,\s]+"), ""))


def unknown_values(requested, allowed) -> Column:
    return F.array_sort(F.array_except(col(requested), col(allowed)))


def _int(length) -> Column:
    return F.lit(length) if isinstance(length, int) else col(length).cast("int")
