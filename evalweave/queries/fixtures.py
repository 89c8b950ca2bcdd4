"""The given tables as the inputs of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import nonblank
from evalweave.queries.registry import Tables

HUMAN = "user"
LENGTHS = [64, 256]
CONCURRENCIES = [1, 8]
PREFIX_SHARES = [None, 85]


#: Sample counts that follow the tables.
ITEMS_SQL = "(SELECT 5 * count(*) + 3 FROM benchmark)"
DOCS_SQL = "(SELECT count(*) + count(*) // 2 FROM documents)"


def items_n(t: Tables) -> int:
    return 5 * t.benchmark.count() + 3


def docs_n(t: Tables) -> int:
    n = t.documents.count()
    return n + n // 2


def k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("bigint")


def problems(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("question_id"), F.col("lang").alias("difficulty"),
        F.col("source").alias("platform"), F.col("text").alias("content"))


def grades(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("passed"))


def graded(t: Tables) -> DataFrame:
    g = grades(t).select("question_id", F.col("passed").alias("p"))
    return problems(t).join(g, "question_id", "left").select(
        "question_id", "difficulty", "platform", "content",
        F.col("p").isNotNull().alias("parsed"), F.col("p").isNotNull().alias("completed"),
        F.coalesce("p", F.lit(False)).alias("passed"))


def state(t: Tables) -> DataFrame:
    """Run state: labelled documents are completed, toxic ones failed; every
    third id is a legacy record without a failure flag."""
    failed = F.col("toxic") == 1
    legacy = F.col("doc_id") % 3 == 0
    error = F.when(failed, F.lit("TimeoutError: late")).when(
        F.col("quality") == 0, F.lit("code_parse_error"))
    return t.labels.select(
        F.col("doc_id").alias("question_id"), F.lit(True).alias("completed"),
        F.when(~legacy, failed).alias("request_failed"), error.alias("error"),
        F.when(F.col("quality") == 1, F.concat(F.lit("print("), F.col("doc_id"), F.lit(")"))).alias("parsed_code"))


def requests(t: Tables) -> DataFrame:
    error = F.col("event_type") == "error"
    # a projection of its own, so that the JSON is read once per row
    return t.events.withColumn("__k", k()).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("case_id"),
        F.col("ts").alias("start"), (~error).alias("ok"), F.col("value").alias("elapsed_seconds"),
        (F.col("value") / 10).alias("ttft_seconds"), F.col("__k").alias("completion_tokens"),
        F.when(error, F.concat(F.lit("E"), F.col("__k") % 3, F.lit(": detail"))).alias("error"))


def chunks(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), "ts",
        F.timestamp_add("SECOND", -k().cast("int"), "ts").alias("started"),
        F.when(kind == "signup", F.lit("")).otherwise(kind).alias("piece"),
        F.when(kind == "purchase", F.lit("stop")).alias("finish_reason"),
        F.when(kind == "view", F.col("props")).alias("usage"))


def acceptance_lines(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("path"),
        F.concat(F.lit("speculative_accepted_tokens: "), k(), F.lit(", speculative_proposed_tokens: "),
                 F.floor("value").cast("bigint")).alias("line"))


def corpus(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text").where(nonblank("text"))


def cases(t: Tables) -> DataFrame:
    """Suppliers as endpoints to test, one dataset type each."""
    kinds = F.array(*[F.lit(x) for x in ("gsm", "sharegpt", "swebench", "other")])
    return t.supplier.select(
        F.col("s_suppkey").alias("ord"), F.get(kinds, (F.col("s_suppkey") % 4).cast("int")).alias("dataset_type"))


def run_files(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("mtime"),
        F.col("o_orderkey").cast("string").alias("path"))


PROBLEMS_SQL = (
    "SELECT doc_id AS question_id, lang AS difficulty, source AS platform, text AS content FROM documents")
GRADED_SQL = """
SELECT d.doc_id AS question_id, d.lang AS difficulty, d.source AS platform, d.text AS content,
       l.doc_id IS NOT NULL AS parsed, l.doc_id IS NOT NULL AS completed,
       coalesce(l.quality = 1, false) AS passed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
STATE_SQL = """
SELECT doc_id AS question_id, true AS completed,
       CASE WHEN doc_id % 3 <> 0 THEN toxic = 1 END AS request_failed,
       CASE WHEN toxic = 1 THEN 'TimeoutError: late' WHEN quality = 0 THEN 'code_parse_error' END AS error,
       CASE WHEN quality = 1 THEN 'print(' || doc_id || ')' END AS parsed_code
FROM labels"""
REQUESTS_SQL = """
SELECT event_id AS request_id, user_id AS case_id, ts AS start, event_type <> 'error' AS ok,
       value AS elapsed_seconds, value / 10 AS ttft_seconds,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens,
       CASE WHEN event_type = 'error'
            THEN 'E' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) || ': detail' END AS error
FROM events"""
CHUNKS_SQL = """
SELECT user_id AS request_id, event_id AS seq, ts, ts - to_seconds(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS started,
       CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS piece,
       CASE WHEN event_type = 'purchase' THEN 'stop' END AS finish_reason,
       CASE WHEN event_type = 'view' THEN props END AS usage
FROM events"""
LINES_SQL = """
SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS path,
       'speculative_accepted_tokens: ' || json_extract_string(props, '$.k') ||
       ', speculative_proposed_tokens: ' || CAST(floor(value) AS BIGINT) AS line
FROM events"""
COUNTS_SQL = f"""
SELECT pos, path, CAST(regexp_extract(line, 'accepted_tokens:\\s*([0-9]+)', 1) AS BIGINT) AS accepted,
       CAST(regexp_extract(line, 'proposed_tokens:\\s*([0-9]+)', 1) AS BIGINT) AS proposed
FROM ({LINES_SQL})"""
TOKENS_SQL = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
CORPUS_SQL = f"""
SELECT doc_id, text, toks, len(toks) AS n FROM (
  SELECT doc_id, text, {TOKENS_SQL.format('text')} AS toks FROM documents) WHERE len(toks) > 0"""
CASES_SQL = """
SELECT s_suppkey AS ord,
       list_extract(['gsm','sharegpt','swebench','other'], CAST(s_suppkey % 4 + 1 AS BIGINT)) AS dataset_type
FROM supplier"""
MATRIX_SQL = f"""
SELECT c.ord, c.dataset_type, l.v AS input_len, n.v AS concurrency, p.v AS pfx,
       row_number() OVER (ORDER BY c.ord, l.i, n.i, p.i) AS seq
FROM ({CASES_SQL}) c
CROSS JOIN (VALUES (0, 64::BIGINT), (1, 256)) l(i, v)
CROSS JOIN (VALUES (0, 1::BIGINT), (1, 8)) n(i, v)
CROSS JOIN (VALUES (0, CAST(NULL AS BIGINT)), (1, 85)) p(i, v)"""
NAMED_SQL = f"""
SELECT *, display_prefix || input_len || '-bs' || concurrency * 10 ||
       CASE WHEN pfx IS NULL THEN '' ELSE '-pfx' || pfx END || '.jsonl' AS artifact
FROM (SELECT *, CASE dataset_type WHEN 'gsm' THEN 'GSM8K-in' WHEN 'sharegpt' THEN 'ShareGPT-in'
                     WHEN 'swebench' THEN 'Swebench-in' END AS display_prefix FROM ({MATRIX_SQL}))
WHERE display_prefix IS NOT NULL"""
RUN_FILES_SQL = "SELECT o_custkey AS key, o_orderdate AS mtime, CAST(o_orderkey AS VARCHAR) AS path FROM orders"
