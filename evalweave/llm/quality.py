"""Quality rules per host.

Each document is measured in its own row. Rule failures are counted by host, the
rates are shrunk towards a beta prior fitted to all hosts, and the hosts that still
fail go back to their documents as verdicts.

Nulls: a null text has no words; a null host is no host, its documents are judged
alone. Empty tables give empty results. Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import BLANK_RUN, BLANKS, nested, pinned
from evalweave.operators.sizes import BROADCAST_BYTES

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a host's documents that may fail one rule, after shrinking.
MAX_HOST_RATE = 0.8
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Document rules counted per host; each is true where the document fails.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "2 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "dup_lines": "n_dup_lines > 30",
}
SALTS = 16


def measured_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the five metrics of ``text``, computed row by row.

    Repeated three-word windows are found by sorting (hash, position) packed into one
    long; neighbours with equal hashes are compared word by word.
    """
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words = F.split(F.btrim(body, F.lit(BLANKS)), BLANK_RUN)
    out = docs.select(
        "*", words.alias("__w"), lines.alias("__lines"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"))
    out = out.withColumn("n_words", F.expr("if(__w[0] = '', 0, size(__w))").cast("bigint"))
    # the position takes the low bits, the hash the rest
    out = out.withColumn("__b", F.expr("cast(ceil(log2(n_words + 1)) as int)"))
    out = out.withColumn("__s", F.expr("""
        if(n_words < 4, array(), sort_array(transform(sequence(0, cast(n_words as int) - 3), i ->
            shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | i)))"""))
    out = out.withColumn("__e", F.expr("""
        if(size(__s) = 0, array(), filter(sequence(1, greatest(1, size(__s) - 1)), i ->
            shiftrightunsigned(get(__s, i) ^ get(__s, i - 1), __b) = 0))"""))
    out = out.withColumn("__pairs", F.expr("""
        filter(transform(__e, i -> named_struct(
            'p', cast(__s[i] & (shiftleft(1L, __b) - 1) as int),
            'q', cast(__s[i - 1] & (shiftleft(1L, __b) - 1) as int))),
            x -> __w[x.p] = __w[x.q] and __w[x.p + 1] = __w[x.q + 1] and __w[x.p + 2] = __w[x.q + 2])"""))
    out = out.withColumn("__at", F.expr("array_sort(array_distinct(concat(__pairs.p, __pairs.q)))"))
    return out.select(
        *docs.columns, "n_words",
        F.expr("if(n_words = 0, 0, length(array_join(__w, '')))").cast("bigint").alias("word_chars"),
        "n_symbols",
        F.expr("size(__lines) - size(array_distinct(__lines))").cast("bigint").alias("n_dup_lines"),
        F.expr("""aggregate(transform(__at, (p, k) -> least(3, coalesce(get(__at, k + 1), p + 3) - p)),
            0L, (a, x) -> a + x)""").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr(f"({RULES['short']}) or ({RULES['repeats']})")


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures of each rule and the shrunk rates.

    The prior of a rule is the beta law whose mean is the overall failure rate and
    whose spread is what the hosts' rates vary beyond chance (method of moments).
    """
    fails = [F.count_if(F.expr(rule)).alias(f"{r}_failed") for r, rule in RULES.items()]
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("documents"), *fails)
    hosts = pinned(hosts, "hosts")
    n, f = F.col("documents"), {r: F.col(f"{r}_failed") for r in RULES}
    moments = hosts.agg(
        F.sum(n).alias("n"), F.count("*").alias("hosts"),
        *[F.sum(f[r]).alias(r) for r in RULES],
        *[F.sum(f[r] * f[r] / n).alias(f"{r}_2") for r in RULES]).first()
    rates = []
    for r in RULES:
        mean = (moments[r] or 0) / (moments["n"] or 1)
        chance = mean * (1 - mean)
        spread = (moments[f"{r}_2"] or 0) / (moments["n"] or 1) - mean * mean
        between = spread - chance * moments["hosts"] / (moments["n"] or 1)
        strength = min(1e4, max(2.0, chance / between - 1 if between > 0 else 1e4))
        rates.append(((f[r] + mean * strength) / (n + strength)).alias(f"{r}_rate"))
    return hosts.select("*", *rates)


def failing_hosts(rates: DataFrame, limit: float = MAX_HOST_RATE) -> DataFrame:
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    return rates.where(worst > limit).select("host")


def judged(measured: DataFrame, host: str, limit: float = MAX_HOST_RATE) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. ``measured`` is read twice, so pin it.

    The failing hosts are broadcast if what was counted fits; otherwise each is dealt
    to ``SALTS`` copies so that a host with a large share of the rows is split.
    """
    failing = pinned(failing_hosts(host_rates(measured, host), limit), "failing")
    size = failing.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0))).first()[0]
    rows = measured.withColumn("base_failed", base_failed())
    if size <= BROADCAST_BYTES // 8:
        marked = rows.join(F.broadcast(failing.withColumn("__bad", F.lit(True))),
                           F.col(host) == F.col("host"), "left")
    else:
        copies = failing.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__c"),
                                F.lit(True).alias("__bad"))
        salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        marked = salted.join(copies, (F.col(host) == F.col("host")) & (F.col("__salt") == F.col("__c")), "left")
    return marked.select(*measured.columns, "base_failed",
                         (~F.col("base_failed") & F.col("__bad").isNull()).alias("kept"))


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: id, metrics, ``base_failed``, ``kept`` and its host."""
    rows = measured_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("__host"),
                                     F.col(text).alias("__text")), F.col("__text"))
    rows = pinned(rows.drop("__text"), "quality")
    return judged(rows, "__host").select("doc_id", *METRICS, "base_failed", "kept", F.col("__host").alias("host"))


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged, whatever their columns are called."""
    rows = nested(docs).select("d", F.col("d")[host].cast("string").alias("__host"))
    rows = pinned(measured_text(rows, F.col("d")[text]), "quality")
    return judged(rows, "__host").where("kept").select("d.*")
