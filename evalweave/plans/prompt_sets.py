"""Prompt sets of an exact token length.

Texts stay out of the shuffles that decide membership: those move ids, counts
and positions only. A text is joined last, and cut to the tokens its sample
still needs before it is grouped, so that no group exceeds the sample length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import nonblank, tile_tokens, token_count, tokens, truncate_tokens
from evalweave.operators.filters import valid_multiturn
from evalweave.operators.joins import cycle_assign, spread_join
from evalweave.operators.ordering import integer_ordered, running_total
from evalweave.operators.sizes import bounded, measured
from evalweave.session import materialize


def fit_length(text: str, length: int) -> tuple[Column, Column]:
    """(text of exactly ``length`` tokens, whether that worked); closed form for
    the default tokenizer, whose counts do not change on joining."""
    return tile_tokens(text, length), nonblank(text)


def _seeded(corpus: DataFrame, key: str, text: str, n_samples: int) -> DataFrame:
    """(sample, key, text) with the corpus cycled over ``n_samples`` samples."""
    usable = corpus.where(nonblank(text))
    # the filter reads the texts, the numbering then only the keys
    keys = materialize(usable.select(key))
    if keys.count() >= n_samples:
        return usable.select(key, text).join(bounded(cycle_assign(keys, key, n_samples), n_samples), key)
    assigned = materialize(cycle_assign(keys, key, n_samples, spread=True))
    return spread_join(assigned, usable.select(key, text), key, "sample")


def build_tiled(corpus: DataFrame, key: str, text: str, length: int, n_samples: int) -> DataFrame:
    """Each text cut or repeated to ``length``; first ``n_samples`` or cycled."""
    return _seeded(corpus, key, text, n_samples).select(
        "sample", key, tile_tokens(text, length).alias("question"))


def build_single(corpus: DataFrame, key: str, text: str, length: int, n_samples: int) -> DataFrame:
    """One seed text per sample, repeated to ``length``, with the exactness flag."""
    fitted, exact = fit_length(text, length)
    return _seeded(corpus, key, text, n_samples).select(
        "sample", key, fitted.alias("question"), exact.alias("exact"))


def corpus_offsets(corpus: DataFrame, key: str, text: str, weight: Column | None = None) -> DataFrame:
    """(key, n_tokens, start, total): token position of each text in the corpus, counted
    by words or by another ``weight``.

    Both steps leave narrow rows that are read several times: the counts, so that
    the texts are tokenized once, and the positions, on which packing builds.
    """
    counts = materialize(corpus.where(nonblank(text)).select(
        key, (token_count(text) if weight is None else weight).alias("n_tokens")))
    counts, by = integer_ordered(counts, key)
    return materialize(running_total(counts, by, weight=F.col("n_tokens")).drop(by))


def key_range(corpus: DataFrame, key: str) -> tuple[int, int, int] | None:
    """(smallest key, largest key, rows) from the footers of the Parquet files that ``corpus``
    is read from, without reading a column; None where there are none, or ``key`` is
    not one of their whole-number columns. A hint: filters of ``corpus`` don't count."""
    files = corpus.inputFiles()
    if not files or dict(corpus.dtypes).get(key) not in ("bigint", "int"):
        return None
    # a session of its own, so that the settings stay here: this reader answers from footers
    session = corpus.sparkSession.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        rows = session.read.parquet(*files)
        if dict(rows.dtypes).get(key) not in ("bigint", "int"):
            return None
        low, high, count = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    except (AnalysisException, PySparkException):
        return None
    return (low, high, count) if low is not None else None


#: Tokens a text is taken to have before any is counted; how much further each step reads.
FIRST_GUESS, STEP = 64, 4


def corpus_head(
    corpus: DataFrame, key: str, text: str, n_tokens: int, enough: Callable[[DataFrame], bool],
) -> tuple[DataFrame, DataFrame]:
    """(texts, offsets) of the beginning of the corpus in key order: as much as ``enough``
    asks for, about ``n_tokens`` tokens.

    The key range of the files tells about which key that is; texts up to it are counted,
    and more are read as long as they don't suffice. The filter on the key reaches the
    scan, which skips row groups behind it. What is read follows ``n_tokens``, not the corpus,
    where files are laid out by key; elsewhere, and for other keys, all of it.
    """
    known = key_range(corpus, key)
    if known is not None:
        low, high, rows = known
        upto = low + max(1, (high - low + 1) * n_tokens // (FIRST_GUESS * max(rows, 1)))
        while upto < high:
            head = corpus.where(F.col(key) <= upto)
            offsets = corpus_offsets(head, key, text)
            if enough(offsets):
                return head, offsets
            upto = low + STEP * (upto - low)
    return corpus, corpus_offsets(corpus, key, text)


def _full_buckets(offsets: DataFrame, length: int, n_samples: int, end: Column | None = None) -> bool:
    """Whether the first ``n_samples`` samples lie before ``end`` with all their texts."""
    bucket = F.floor(F.col("start") / length)
    end = F.col("total") if end is None else end
    return offsets.where((bucket + 2) * length <= end).agg(F.countDistinct(bucket)).first()[0] >= n_samples


def repeated(offsets: DataFrame, key: str, until: Column) -> DataFrame:
    """Positions of each text when the corpus repeats up to token ``until``."""
    last = F.floor((until - 1 - F.col("start")) / F.col("total")).cast("bigint")
    first = F.lit(0).cast("bigint")
    return offsets.where(last >= 0).select(
        key, "n_tokens", "total", "start", F.explode(F.sequence(first, last)).alias("__c"),
    ).select(key, "n_tokens", (F.col("start") + F.col("__c") * F.col("total")).alias("at"))


def pack_by_budget(offsets: DataFrame, key: str, length: int) -> DataFrame:
    """Members (bucket, key, at, take) of samples of ``length`` tokens.

    Sample k begins at the first text that starts in [k*L, (k+1)*L) and takes the
    texts that start within L tokens of it. As it begins inside its bucket, a text
    belongs to the sample of its own or of the preceding bucket: an equi-join.
    The corpus repeats behind its end so that the last samples fill up too; a text
    on a seam may serve two neighbouring samples.
    """
    bucket = F.floor(F.col("start") / length).cast("bigint")
    seeds = offsets.groupBy(bucket.alias("bucket")).agg(F.min("start").alias("first"))
    own = F.floor(F.col("at") / length).cast("bigint")
    candidates = repeated(offsets, key, F.col("total") + length).select(
        "*", F.explode(F.array(own - 1, own)).alias("bucket"))
    end = F.col("first") + length
    return candidates.join(seeds, "bucket").where(
        (F.col("at") >= F.col("first")) & (F.col("at") < end)
    ).select("bucket", key, "at", F.least(F.col("n_tokens"), end - F.col("at")).alias("take"))


def cut_and_join(
    members: DataFrame, corpus: DataFrame, key: str, text: str, by: list[str], length: int,
) -> DataFrame:
    """Member texts cut to ``take`` and joined in order: at most L tokens a group.

    No member takes more than ``length`` tokens, so texts are cut to that before they move.
    """
    parts = corpus.select(key, truncate_tokens(text, length).alias(text)).join(members, key).select(
        *by, "at", "take", truncate_tokens(text, "take").alias("part"))
    return parts.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("__parts"),
        F.sum("take").alias("n_tokens"), F.count("*").alias("draws"),
    ).select(
        *by, F.array_join(F.transform("__parts", lambda p: p["part"]), "\n\n").alias("question"),
        "n_tokens", "draws")


def _finish_concat(
    members: DataFrame, corpus: DataFrame, key: str, text: str, offsets: DataFrame, length: int,
    n_samples: int | None,
) -> DataFrame:
    """Number the samples and write out their texts."""
    buckets = offsets.select(F.floor(F.col("start") / length).cast("bigint").alias("bucket")).distinct()
    if n_samples is None:
        # one sample per bucket: numbered while the rows are still narrow
        numbers = running_total(buckets, "bucket", start="sample").select("bucket", "sample")
        members = members.join(numbers, "bucket").drop("bucket")
        return cut_and_join(members, corpus, key, text, ["sample"], length)
    numbers = cycle_assign(buckets, "bucket", n_samples)
    members = measured(members.join(numbers.select("bucket").distinct(), "bucket", "left_semi"))
    built = cut_and_join(members, corpus, key, text, ["bucket"], length)
    return built.join(numbers, "bucket").select("sample", "question", "n_tokens", "draws")


def build_concat(
    corpus: DataFrame, key: str, text: str, length: int, n_samples: int | None = None,
) -> DataFrame:
    """Samples that each pack different texts to exactly ``length`` tokens.

    Without ``n_samples`` the corpus is used once; beyond its end samples repeat. For a
    few samples only the beginning of the corpus is read (``corpus_head``).
    """
    if n_samples is None:
        offsets = corpus_offsets(corpus, key, text)
    else:
        corpus, offsets = corpus_head(corpus, key, text, length * (n_samples + 2),
                                      lambda head: _full_buckets(head, length, n_samples))
    members = pack_by_budget(offsets, key, length)
    return _finish_concat(members, corpus, key, text, offsets, length, n_samples)


def build_prefix(
    corpus: DataFrame, key: str, text: str, length: int, percent: int, n_samples: int | None = None,
) -> DataFrame:
    """Samples that share their first ``length * percent / 100`` tokens and differ after.

    The prefix is packed from the head of the corpus, the suffixes from the texts
    behind it, wrapping around.
    """
    shared = length * percent // 100
    if not 0 < shared < length:
        raise ValueError(f"a prefix share of {percent}% leaves no prefix or no suffix")
    rest = length - shared

    def enough(head: DataFrame) -> bool:
        behind = head.where(F.col("start") >= shared)
        first = behind.agg(F.min("start")).first()[0]
        return first is not None and _full_buckets(
            behind.withColumn("start", F.col("start") - first), rest, n_samples, F.col("total") - first)

    if n_samples is None:
        offsets = corpus_offsets(corpus, key, text)
    else:
        corpus, offsets = corpus_head(corpus, key, text, shared + rest * (n_samples + 2), enough)
    head = repeated(offsets, key, F.lit(shared)).select(
        key, "at", F.least(F.col("n_tokens"), F.lit(shared) - F.col("at")).alias("take"))
    # every member holds a token, so there are at most `shared` of them, and one row
    # of `shared` tokens comes out
    prefix = cut_and_join(bounded(head, shared), corpus, key, text, [], shared).select("question").scalar()
    behind = offsets.where(F.col("start") >= shared).agg(F.min("start")).scalar()
    turned = offsets.withColumn(
        "start", F.pmod(F.col("start") - F.coalesce(behind, F.lit(0)), F.col("total")))
    members = pack_by_budget(turned, key, rest)
    suffixes = _finish_concat(members, corpus, key, text, turned, rest, n_samples)
    return suffixes.select(
        "sample", F.concat(prefix, F.lit("\n\n"), F.col("question")).alias("question"),
        (F.col("n_tokens") + shared).alias("n_tokens"), "draws")


def prefix_audit(samples: DataFrame, text: str) -> DataFrame:
    """Tokens shared by all samples.

    The common prefix of a set is that of its smallest and largest member, so two
    mergeable aggregates replace a comparison per position.
    """
    ends = samples.select(tokens(text).alias("__t")).agg(
        F.count("*").alias("samples"), F.min("__t").alias("a"), F.max("__t").alias("b"))
    differs = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    return ends.select(
        "samples", F.when(differs > 0, differs - 1).otherwise(F.size("a")).cast("bigint").alias("shared"))


def multiturn_subset(turns: DataFrame, human: str, n: int = 0) -> DataFrame:
    """All turns of the first ``n`` valid chats."""
    chats = valid_multiturn(turns, human, n)
    return turns.join(bounded(chats, n) if n > 0 else chats, "conv_id", "left_semi")


def multiturn_chats(chats: DataFrame, human: str) -> DataFrame:
    """The same filter for nested chats, row by row."""
    n = F.size("conversations")
    return chats.where((n >= 2) & (n % 2 == 0) & (F.get("conversations", F.lit(0))["from"] == human))


def repeat_samples(samples: DataFrame, times: int) -> DataFrame:
    return samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(times, 1) - 1))).alias("repeat"))
