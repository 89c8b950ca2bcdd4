"""The queries of this folder, with SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import table
from evalweave.session import scratch_path
from evalweave.llm import (
    decontam, exacttop, lexical, licenses, linededup, nearjoin, periodic, pieces, quality, rollups, sharding, tokenfile, toxicity)


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers
    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


#: Metrics and base verdict of table ``{docs}``, as (doc_id, text, host, metrics, base_failed).
QUALITY_CTE = r"""
q_words AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') END AS w,
    CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) END AS lines
    FROM {docs}),
q_win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM q_words WHERE len(w) >= 3),
q_rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM q_win),
q_cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM q_rep, range(0, 3) t(k) WHERE c > 1 GROUP BY doc_id),
q_met AS (SELECT q.doc_id, q.source, len(w)::BIGINT AS n_words,
    coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM q_words q LEFT JOIN q_cov c USING (doc_id)),
q_base AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM q_met),
q_host AS (SELECT source, count(*) AS n, rule, count(*) FILTER (WHERE failed) AS f FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'word_length', 'dup_lines']) AS rule,
    unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 2 * n_symbols > n_words,
        word_chars < 2 * n_words OR word_chars > 20 * n_words, n_dup_lines > 30]) AS failed
    FROM q_base WHERE source IS NOT NULL) GROUP BY source, rule),
q_mom AS (SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS m2, count(*) / sum(n) AS h FROM q_host GROUP BY rule),
q_prior AS (SELECT rule, m, least(1e4, greatest(2.0, CASE WHEN m2 - m * m - m * (1 - m) * h > 0
    THEN m * (1 - m) / (m2 - m * m - m * (1 - m) * h) - 1 ELSE 1e4 END)) AS k FROM q_mom),
q_bad AS (SELECT DISTINCT source FROM q_host JOIN q_prior USING (rule) WHERE (f + m * k) / (n + k) > 0.8)"""


@query("op2_quality_rules", "WITH " + QUALITY_CTE.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM q_bad)) AS kept, source AS host FROM q_base""")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


#: Kept text of every row of ``{docs}`` after line deduplication, as (doc_id, n_lines, n_dropped, kept).
LINES_CTE = r"""
l_lines AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {docs}),
l_keys AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l_lines),
l_drop AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM l_keys),
l_kept AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept
    FROM l_drop GROUP BY doc_id)"""


@query("op7_line_dedup", "WITH " + LINES_CTE.replace("{docs}", "documents") + """,
l_runs AS (SELECT doc_id, min(pos) AS a, count(*) AS n FROM (
    SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l_drop WHERE NOT dropped) GROUP BY doc_id, g),
l_maps AS (SELECT doc_id, string_agg((a - 1) || '+' || n, ' ' ORDER BY a) AS runs FROM l_runs GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256, coalesce(runs, '') AS keep_runs FROM l_kept LEFT JOIN l_maps USING (doc_id)""")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """With each document's keep bitmap as runs of kept lines, ``first line+lines``."""
    rows = linededup.digest(table(spark, folder, "documents"))
    runs = F.array_join(F.transform("keep", lambda r: F.concat_ws("+", r["start"], r["length"])), " ")
    whole = F.concat(F.lit("0+"), "n_lines")
    return rows.withColumn("keep_runs", F.when(F.col("keep").isNull(), whole).otherwise(runs)).drop("keep")


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return nearjoin.join(table(spark, folder, "documents"))


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokenfile.encode_and_read(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", rows["crc"].alias("ids_crc32"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.assign(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_token_rollups", r"""
WITH w AS (SELECT d.source, d.lang, d.doc_id, l.quality,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    octet_length(encode(coalesce(text, ''))) AS bytes
    FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))
SELECT source, lang, tokenizer, sum(documents)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM (
    SELECT source, lang, 'words' AS tokenizer, 1 AS documents, words AS tokens FROM w WHERE quality IS DISTINCT FROM 0
    UNION ALL SELECT source, lang, 'bytes', 1, bytes FROM w) GROUP BY ALL HAVING sum(documents) <> 0 OR sum(tokens) <> 0""")
def op5_token_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Four batches: all documents counted as bytes; all as words, first by an estimate;
    the estimates revised to counts; documents of quality 0 deleted from the words. The
    third is sent twice, as after a lost answer."""
    docs = table(spark, folder, "documents")
    poor = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 0")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    estimate = (size / 6).cast("bigint")
    words = rollups.word_count(F.col("text"))
    store = rollups.Store(spark, scratch_path(spark, "rollups"))
    store.commit(1, rollups.changes(docs, "insert", "bytes", size))
    store.commit(2, rollups.changes(docs, "insert", "words", estimate))
    for _ in range(2):
        store.commit(3, rollups.changes(docs, "revise", "words", words, estimate))
    # counted first, so that no text moves
    counted = docs.select("doc_id", "source", "lang", words.alias("words"))
    gone = counted.join(poor.select("doc_id"), "doc_id", "left_semi")
    store.commit(4, rollups.changes(gone, "delete", "words", F.lit(0), F.col("words")))
    return store.totals()


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.find(periodic.planted(table(spark, folder, "documents"))))


def terms_sql(text: str) -> str:
    return (f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


@query("op12_lexical_search", f"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest({terms_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
words AS (SELECT doc_id, {terms_sql("text")} AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, len(w) AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, totals GROUP BY term, n_docs),
shares AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS share
    FROM held JOIN docs USING (doc_id) JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, sum(times * share)::BIGINT AS score FROM q JOIN shares USING (term) GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM places WHERE place <= 20""")
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query("op13_exact_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1),
        lambda i: q.e[i] * c.e[i]))::BIGINT AS score
    FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INT AS rank, vec_id, score FROM places WHERE place <= 10""")
def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exacttop.search(table(spark, folder, "embeddings")).drop("query_hash")
