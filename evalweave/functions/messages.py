"""Chat messages, streamed chunks and polymorphic scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions.text import col, strip


def flatten_messages(raw) -> Column:
    """A prompt as plain text, which stays as it is, or as a JSON array of messages
    whose content is a string or a list of parts. Messages are joined by a blank
    line, parts by a newline."""
    v = F.try_parse_json(col(raw))

    def part_text(p: Column) -> Column:
        return F.coalesce(F.try_variant_get(p, "$.text", "string"), p.cast("string"))

    def content_text(m: Column) -> Column:
        content = F.try_variant_get(m, "$.content", "variant")
        parts = F.try_variant_get(m, "$.content", "array<variant>")
        plain = F.coalesce(content.cast("string"), F.lit(""))
        return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part_text), "\n")).otherwise(plain)

    messages = F.try_variant_get(v, "$", "array<variant>")
    return F.when(
        messages.isNotNull(), F.array_join(F.transform(messages, content_text), "\n\n")
    ).otherwise(col(raw))


def decode_chunk(line) -> Column:
    """One line of a streamed response as (done, piece, finish_reason, usage).

    Lines that are not ``data:`` or hold broken JSON give nulls; an ended stream
    sets ``done``.
    """
    text = strip(line)
    is_data = F.startswith(text, F.lit("data:"))
    body = strip(F.substring(text, 6, 2**31 - 1))
    done = is_data & (body == F.lit("[DONE]"))
    chunk = F.when(is_data & ~done, F.try_parse_json(body))
    piece = F.coalesce(
        F.try_variant_get(chunk, "$.choices[0].delta.content", "string"),
        F.try_variant_get(chunk, "$.choices[0].text", "string"),
    )
    return F.struct(
        F.coalesce(done, F.lit(False)).alias("done"),
        F.nullif(piece, F.lit("")).alias("piece"),
        F.try_variant_get(chunk, "$.choices[0].finish_reason", "string").alias("finish_reason"),
        F.to_json(F.try_variant_get(chunk, "$.usage", "variant")).alias("usage"),
    )


def score_value(raw) -> Column:
    """JSON text of a score: a number, or the first entry of an object; null is 0.

    ``from_json`` to a map keeps the order of the text, a variant would not.
    """
    text = col(raw)
    first = F.get(F.map_values(F.from_json(text, "map<string,double>")), F.lit(0))
    return F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("{")), first).otherwise(
        text.try_cast("double")), F.lit(0.0))
