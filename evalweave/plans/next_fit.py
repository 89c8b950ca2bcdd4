"""Next-fit packing without a cursor.

A sample takes texts in key order until it holds its budget; the next one begins with the
text behind. Where a sample begins thus follows from where the one before began, and so
each text has one successor: the text at which the next sample would begin if a sample
began here. Only the chain of successors from the first text counts, and it is found by
pointer doubling:

* Successors come from the running token counts alone (``successors``): the text that holds
  the last wanted token ends the sample. Texts and wanted tokens meet in buckets of the
  token axis, an equi-join by position.
* Links of 2^k samples are links of 2^(k-1) samples joined with themselves. Chains soon fall
  together, so each level keeps only the places that the level below reaches at all,
  and the levels shrink.
* Sample 0 begins at 0; from the longest links down, each level doubles the samples known.

All steps are joins of narrow rows, whatever the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.functions.text import token_count
from evalweave.operators.joins import spread_join
from evalweave.plans.prompt_sets import corpus_offsets, cut_and_join, repeated
from evalweave.session import materialize

#: Samples known so far are sent to all tasks up to this many; larger sides of joins are shuffled
#: and merged, as levels that each just pass for small would all go through the driver.
FEW = 1 << 12
#: Tokens of one bucket; a bucket holds at most one text and one wanted token for each.
BUCKET = 1 << 16


def _cover(begin: Column, end: Column, width: int) -> Column:
    """One row per bucket that [begin, end) touches."""
    return F.explode(F.sequence(F.floor(begin / width), F.floor((end - 1) / width)))


def successors(offsets: DataFrame, budget: int) -> DataFrame:
    """(node, next, laps): a sample that begins at token ``node`` is followed by one at
    ``next``, after so many ends of the corpus. ``node`` is the start of a text."""
    stop = F.col("start") + F.col("n_tokens")
    texts = offsets.select("start", stop.alias("stop"), "total", _cover(F.col("start"), stop, BUCKET).alias("bucket"))
    texts = texts.select("bucket", F.greatest(F.col("start"), F.col("bucket") * BUCKET).alias("at"), F.lit(0).alias("asks"), "stop",
                         F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("laps"), "total")
    last = F.col("start") + F.lit(budget - 1)
    asked = offsets.select("start", "total", F.pmod(last, F.col("total")).alias("at"), F.floor(last / F.col("total")).alias("laps"))
    asked = asked.select(F.floor(F.col("at") / BUCKET).alias("bucket"), "at", F.lit(1).alias("asks"),
                         F.lit(None).cast("bigint").alias("stop"), F.col("start").alias("node"), "laps", "total")
    so_far = W.partitionBy("bucket").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0)
    ends = texts.unionByName(asked).withColumn("stop", F.last("stop", ignorenulls=True).over(so_far)).where("asks = 1")
    around = F.col("stop") == F.col("total")
    return ends.select("node", F.when(around, F.lit(0)).otherwise(F.col("stop")).cast("bigint").alias("next"),
                       (F.col("laps") + around.cast("bigint")).alias("laps"))


def _joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Links of ``first`` followed by links of ``second``."""
    then = second.select(F.col("node").alias("__at"), F.col("next").alias("__next"), F.col("laps").alias("__laps"))
    return first.join(then.hint("merge"), F.col("next") == F.col("__at")).select(
        "node", F.col("__next").alias("next"), (F.col("laps") + F.col("__laps")).alias("laps"))


def sample_starts(links: DataFrame, n_samples: int | None = None) -> DataFrame:
    """(sample, node, laps) along the chain from token 0: ``n_samples`` of them, or until the
    corpus ends."""
    level = materialize(links if n_samples is not None else links.where("laps = 0"))
    levels = []
    origin = level.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("next"))
    while (1 << len(levels)) < n_samples if n_samples is not None else not level.where("node = 0").isEmpty():
        levels.append(level)
        reached = level.select("next").unionByName(origin).distinct().withColumnRenamed("next", "__r")
        level = materialize(_joined(level.join(reached.hint("merge"), F.col("node") == F.col("__r"), "left_semi"), level))
    none = F.lit(0).cast("bigint")
    found = origin.select(none.alias("sample"), F.col("next").alias("node"), none.alias("laps"))
    for k in reversed(range(len(levels))):
        step = levels[k].select(F.col("node").alias("__at"), "next", F.col("laps").alias("more"))
        few = 1 << (len(levels) - 1 - k) <= FEW  # each level doubles the samples, at most
        later = found.hint("broadcast" if few else "merge").join(step, F.col("node") == F.col("__at")).select(
            (F.col("sample") + (1 << k)).alias("sample"), F.col("next").alias("node"), (F.col("laps") + F.col("more")).alias("laps"))
        found = materialize(found.unionByName(later))
    return found if n_samples is None else found.where(F.col("sample") < n_samples)


def _members(offsets: DataFrame, links: DataFrame, starts: DataFrame, key: str, budget: int, cycled: bool) -> DataFrame:
    """(node, key, offset, n_tokens): the texts of a sample that begins at ``node``."""
    total = offsets.agg(F.max("total")).scalar()
    until = F.col("next") + F.col("laps") * total
    spans = materialize(starts.select("node").distinct().join(links.hint("merge"), "node").select(
        "node", (until if cycled else F.least(until, total)).alias("until")))
    furthest = spans.agg(F.coalesce(F.max("until"), F.lit(0))).scalar()
    texts = repeated(offsets, key, furthest).select("*", F.floor(F.col("at") / budget).alias("bucket"))
    covered = spans.select("*", _cover(F.col("node"), F.col("until"), budget).alias("bucket"))
    return texts.join(covered.hint("merge"), "bucket").where((F.col("at") >= F.col("node")) & (F.col("at") < F.col("until"))).select(
        "node", key, (F.col("at") - F.col("node")).alias("offset"), "n_tokens")


def pack_next_fit(offsets: DataFrame, key: str, budget: int, n_samples: int | None = None) -> DataFrame:
    """Members (sample, key, offset, n_tokens) of samples that each take whole texts until
    they hold ``budget`` tokens. Without ``n_samples`` the corpus is used once, and its last
    sample may hold less; with it the corpus repeats behind its end.

    ``offsets`` as of ``corpus_offsets``: each text holds a token at least.
    """
    starts, members = _packed(offsets, key, budget, n_samples)
    return spread_join(starts, members, "node", "sample").select("sample", key, "offset", "n_tokens")


def _packed(offsets: DataFrame, key: str, budget: int, n_samples: int | None) -> tuple[DataFrame, DataFrame]:
    if budget < 1 or n_samples is not None and n_samples < 0:
        raise ValueError(f"no samples of {budget} tokens, or {n_samples} of them")
    if n_samples is None and offsets.isEmpty():
        n_samples = 0
    links = materialize(successors(offsets, budget))
    starts = materialize(sample_starts(links, n_samples).select("sample", "node"))
    return starts, _members(offsets, links, starts, key, budget, n_samples is not None)


def build_next_fit(
    corpus: DataFrame, key: str, text: str, length: int, n_samples: int | None = None,
) -> DataFrame:
    """Samples of exactly ``length`` tokens, each of whole texts but for the last, which is
    cut; no text serves two samples until the corpus repeats. Without ``n_samples`` a last
    sample may be short."""
    offsets = corpus_offsets(corpus, key, text, token_count(text))
    starts, members = _packed(offsets, key, length, n_samples)
    members = members.select("node", key, F.col("offset").alias("at"),
                             F.least(F.col("n_tokens"), F.lit(length) - F.col("offset")).alias("take"))
    built = cut_and_join(members, corpus, key, text, ["node"], length)
    return spread_join(starts, built, "node", "sample").select("sample", "question", "n_tokens", "draws")
