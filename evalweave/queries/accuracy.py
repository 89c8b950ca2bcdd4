"""Accuracy queries: grades, scopes, errors and completeness."""

from pyspark.sql import functions as F

from evalweave.functions.metrics import safe_ratio, tpot
from evalweave.functions.text import error_category
from evalweave.operators import aggregates as A
from evalweave.operators import filters as FL
from evalweave.operators import joins as J
from evalweave.operators import ordering as O
from evalweave.plans import evaluation as E
from evalweave.queries import fixtures as X
from evalweave.queries.registry import query
from evalweave.session import scratch_path
from evalweave.sinks.writers import subset_summary
from evalweave.sinks.writers import write_predictions as write_predictions_to
from evalweave.streaming import state as ST

RATE = "round(coalesce(CAST(sum(passed::INT) AS DOUBLE) / nullif(count(*), 0), 0), 6)"
SUMS = f"CAST(sum(passed::INT) AS BIGINT) AS passed, count(*) AS total, {RATE} AS pass_at_1"
SCOPES_SQL = f"""
WITH g AS ({X.GRADED_SQL})
SELECT 'overall' AS scope, 'all' AS name, {SUMS} FROM g
UNION ALL SELECT 'difficulty', difficulty, {SUMS} FROM g GROUP BY difficulty
UNION ALL SELECT 'platform', platform, {SUMS} FROM g GROUP BY platform"""


@query("accuracy_scopes", SCOPES_SQL)
def accuracy_scopes(t):
    return A.accuracy_scopes(X.graded(t))


@query("union_scopes", SCOPES_SQL)
def union_scopes(t):
    return A.union_scopes(X.graded(t))


@query("accuracy_by", f"SELECT difficulty AS name, {SUMS} FROM ({X.GRADED_SQL}) GROUP BY difficulty")
def accuracy_by(t):
    return A.accuracy_by(X.graded(t), "difficulty")


@query("pass_at_1", f"SELECT {SUMS} FROM ({X.GRADED_SQL})")
def pass_at_1(t):
    return A.pass_at_1(X.graded(t))


@query("parse_rates", f"""
SELECT CAST(sum(parsed::INT) AS BIGINT) AS parsed, CAST(sum(passed::INT) AS BIGINT) AS passed, count(*) AS total,
       round(coalesce(sum(parsed::INT)::DOUBLE / nullif(count(*), 0), 0), 6) AS parsed_success_rate,
       round(coalesce(sum(passed::INT)::DOUBLE / nullif(sum(parsed::INT), 0), 0), 6) AS pass_rate_among_parsed
FROM ({X.GRADED_SQL})""")
def parse_rates(t):
    return A.parse_rates(X.graded(t))


@query("error_categories", f"""
SELECT split_part(error, ':', 1) AS category, count(*) AS n FROM ({X.REQUESTS_SQL})
WHERE error <> '' GROUP BY 1""")
def error_categories(t):
    return A.error_categories(X.requests(t), "error")


@query("error_category", f"""
SELECT request_id, split_part(error, ':', 1) AS category FROM ({X.REQUESTS_SQL}) WHERE error IS NOT NULL""")
def error_category_of(t):
    return X.requests(t).where("error is not null").select(
        "request_id", error_category("error").alias("category"))


@query("micro_macro", f"""
SELECT round(sum(num * score) / sum(num), 6) AS score, round(avg(score), 6) AS macro_score,
       CAST(sum(num) AS BIGINT) AS num, count(*) AS subsets
FROM (SELECT platform, count(*) AS num, avg(passed::INT) AS score FROM ({X.GRADED_SQL}) GROUP BY platform)""")
def micro_macro(t):
    return A.micro_macro(X.graded(t), "platform")


@query("completeness", """
SELECT count(*) AS rows, count(DISTINCT CASE WHEN NOT malformed THEN text END) AS "unique",
       count(*) FILTER (completed) AS completed, count(*) FILTER (regexp_matches(text, '\\S')) AS nonempty,
       count(*) FILTER (completed) AS parsed,
       count(*) - count(DISTINCT CASE WHEN NOT malformed THEN text END) AS duplicate_ids
FROM (SELECT d.text, d.n_chars < 50 AS malformed, l.doc_id IS NOT NULL AS completed
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def completeness(t):
    rows = X.graded(t).join(t.documents.select(F.col("doc_id").alias("question_id"), "n_chars"), "question_id")
    # distinct texts by digest: whole texts count, but do not travel
    return A.completeness(rows, F.sha2("content", 256), F.col("n_chars") < 50)


@query("pending", f"""
SELECT question_id, difficulty FROM ({X.PROBLEMS_SQL}) p
WHERE NOT EXISTS (SELECT 1 FROM ({X.STATE_SQL}) s WHERE s.question_id = p.question_id AND s.completed)""")
def pending(t):
    return J.pending(X.problems(t), X.state(t), "question_id").select("question_id", "difficulty")


@query("attach_state", f"""
SELECT p.question_id, p.difficulty, coalesce(s.parsed_code, '') AS parsed_code
FROM ({X.PROBLEMS_SQL}) p LEFT JOIN ({X.STATE_SQL}) s ON p.question_id = s.question_id""")
def attach_state(t):
    return J.attach_state(X.problems(t).select("question_id", "difficulty"), X.state(t), "question_id")


@query("attach_grade", f"SELECT question_id, difficulty, platform, passed FROM ({X.GRADED_SQL})")
def attach_grade(t):
    p = X.problems(t).select("question_id", "difficulty", "platform")
    return J.attach_grade(p, X.grades(t), "question_id")


@query("write_predictions", f"""
SELECT p.question_id, '["' || coalesce(s.parsed_code, '') || '"]' AS code_list
FROM ({X.PROBLEMS_SQL}) p LEFT JOIN ({X.STATE_SQL}) s ON p.question_id = s.question_id""")
def write_predictions(t):
    attached = J.attach_state(X.problems(t).select("question_id"), X.state(t), "question_id")
    path = scratch_path(t.spark, "predictions")
    write_predictions_to(attached, "question_id", path)
    written = t.spark.read.schema("question_id bigint, code_list array<string>").json(f"{path}/predictions")
    return written.select("question_id", F.to_json("code_list").alias("code_list"))


SUCCEEDED = """(completed AND CASE WHEN request_failed IS NULL
    THEN coalesce(error, '') IN ('', 'code_parse_error') ELSE NOT request_failed END)"""


@query("request_succeeded", f"SELECT question_id, {SUCCEEDED} AS succeeded FROM ({X.STATE_SQL})")
def request_succeeded(t):
    ok = FL.request_succeeded("completed", "request_failed", "error")
    return X.state(t).select("question_id", ok.alias("succeeded"))


@query("mark_outcome", """
SELECT doc_id AS question_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty_content'
       WHEN NOT regexp_matches(code, '\\S') THEN 'code_parse_error' END AS error
FROM (SELECT doc_id, text, CASE WHEN contains(text, '```') OR n_chars % 2 = 0 THEN text ELSE ' ' END AS code
      FROM documents)""")
def mark_outcome(t):
    code = F.when(F.col("text").contains("```") | (F.col("n_chars") % 2 == 0), F.col("text")).otherwise(F.lit(" "))
    return t.documents.withColumn("code", code).select(
        F.col("doc_id").alias("question_id"), FL.mark_outcome("text", "code").alias("error"))


@query("filter_difficulty", f"SELECT question_id, difficulty FROM ({X.PROBLEMS_SQL}) WHERE lower(difficulty) IN ('de', 'fr')")
def filter_difficulty(t):
    return FL.filter_values(X.problems(t), "difficulty", ["DE", "Fr"]).select("question_id", "difficulty")


WANTED_SQL = "SELECT DISTINCT d.source AS name FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1 UNION SELECT n_name FROM nation"


def _wanted(t):
    toxic = t.labels.where("toxic = 1").select("doc_id")
    return t.documents.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("name")).union(
        t.nation.select("n_name")).distinct()


@query("filter_subset", f"""
SELECT question_id, platform FROM ({X.PROBLEMS_SQL}) WHERE platform IN (SELECT name FROM ({WANTED_SQL}))""")
def filter_subset(t):
    return FL.filter_subset(X.problems(t), "platform", _wanted(t)).select("question_id", "platform")


@query("unknown_subset", f"""
SELECT name FROM ({WANTED_SQL}) WHERE name NOT IN (SELECT source FROM documents)""")
def unknown_subset(t):
    return FL.unknown_names(X.problems(t), "platform", _wanted(t))


@query("filter_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def filter_ids(t):
    return FL.filter_ids(t.documents.select("doc_id", "source"), "doc_id", t.labels)


@query("dedup_first", """
SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text""")
def dedup_first(t):
    rows = t.documents.select(F.md5("text").alias("text_md5"), "doc_id", "lang")
    return O.dedup_first(rows, "text_md5", "doc_id")


@query("limit_per_group_count", """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3""")
def limit_per_group_count(t):
    return O.limit_per_group(t.documents.select("doc_id", "source"), "source", "doc_id", 3)


@query("limit_per_group_share", """
SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= ceil(0.25 * count(*) OVER (PARTITION BY source))""")
def limit_per_group_share(t):
    return O.limit_per_group(t.documents.select("doc_id", "source"), "source", "doc_id", 0.25)


@query("order_problems", """
SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank FROM orders""")
def order_problems(t):
    return A.order_problems(t.orders, "o_orderdate", "o_orderkey")


@query("head_n", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def head_n(t):
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return FL.head_n(rows, ["o_orderdate", "o_orderkey"], 50).drop("o_orderdate")


@query("order_case_keys", """
SELECT key, row_number() OVER (ORDER BY length(key), key) AS rank
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders)""")
def order_case_keys(t):
    return A.order_case_keys(t.orders.select(F.col("o_orderkey").cast("string").alias("key")), "key")


@query("order_scopes", f"""
SELECT scope, name, row_number() OVER (ORDER BY
         CASE scope WHEN 'overall' THEN 0 WHEN 'difficulty' THEN 1 ELSE 2 END,
         CASE WHEN scope = 'difficulty' THEN list_position(['en','fr','de','es'], name) ELSE 0 END, scope, name) AS rank
FROM ({SCOPES_SQL})""")
def order_scopes(t):
    rows = A.accuracy_scopes(X.graded(t)).select("scope", "name")
    return A.order_scopes(rows, ["en", "fr", "de", "es"])


@query("write_summaries", f"""
SELECT platform AS subset, count(*) AS num, printf('%.6f', avg(passed::INT)) AS acc
FROM ({X.GRADED_SQL}) GROUP BY platform""")
def write_summaries(t):
    rows = A.accuracy_by(X.graded(t), "platform")
    return subset_summary(rows.select("name", F.col("total").alias("num"), F.col("pass_at_1").alias("score")))


@query("safe_ratio", """
SELECT doc_id, round(n_words / nullif(hits, 0)::DOUBLE, 6) AS ratio_null,
       round(coalesce(n_words / nullif(hits, 0)::DOUBLE, 0), 6) AS ratio_zero
FROM (SELECT doc_id, n_chars AS n_words, n_chars % 3 AS hits FROM documents)""")
def ratios(t):
    hits = F.col("n_chars") % 3
    return t.documents.select(
        "doc_id", safe_ratio(F.col("n_chars"), hits).alias("ratio_null"),
        safe_ratio(F.col("n_chars"), hits, 0).alias("ratio_zero"))


@query("reset_failed", f"""
SELECT question_id, coalesce(error, '') AS error FROM ({X.STATE_SQL}) WHERE {SUCCEEDED}""")
def reset_failed(t):
    store, schema = scratch_path(t.spark, "state"), "question_id bigint, completed boolean, request_failed boolean, error string"
    ST.upsert_state(X.state(t).select("question_id", "completed", "request_failed", "error", F.lit(0).alias("seq")), 0, store)
    ST.reset_failed(t.spark, store, schema)
    return ST.read_run_state(t.spark, store, schema).select("question_id", F.coalesce("error", F.lit("")).alias("error"))


@query("upsert_state", f"""
SELECT question_id, error FROM ({X.STATE_SQL}) WHERE NOT {SUCCEEDED} IS TRUE AND question_id % 2 = 1
UNION ALL SELECT question_id, 'rerun' FROM ({X.STATE_SQL}) WHERE NOT {SUCCEEDED} IS TRUE AND question_id % 2 = 0
UNION ALL SELECT question_id, error FROM ({X.STATE_SQL}) WHERE {SUCCEEDED}""")
def upsert_state(t):
    store = scratch_path(t.spark, "state")
    stored = X.state(t).select("question_id", "error", F.lit(0).alias("seq"),
                               FL.request_succeeded("completed", "request_failed", "error").alias("ok"))
    rerun = stored.where(~F.col("ok") & (F.col("question_id") % 2 == 0)).withColumn("error", F.lit("rerun"))
    for batch, rows in enumerate((stored, rerun)):
        ST.upsert_state(rows.drop("ok"), batch, store)
    return ST.read_run_state(t.spark, store, "question_id bigint, error string")


@query("evaluation_summary", f"""
SELECT scope AS part, name, m.x AS metric, round(CASE m.x WHEN 'passed' THEN passed WHEN 'total' THEN total ELSE pass_at_1 END, 6) AS value
FROM ({SCOPES_SQL}), (VALUES ('passed'), ('total'), ('pass_at_1')) m(x)
UNION ALL SELECT 'errors', split_part(error, ':', 1), 'n', count(*)::DOUBLE FROM ({X.REQUESTS_SQL}) WHERE error <> '' GROUP BY 2
UNION ALL SELECT 'timing', c, m.x, round(CASE m.x WHEN 'count' THEN count(v) WHEN 'mean' THEN avg(v)
  WHEN 'p50' THEN quantile_cont(v, 0.5) WHEN 'p95' THEN quantile_cont(v, 0.95)
  WHEN 'p99' THEN quantile_cont(v, 0.99) ELSE max(v) END, 6)
FROM (UNPIVOT (SELECT ttft_seconds, (elapsed_seconds - ttft_seconds) / nullif(completion_tokens - 1, 0) AS tpot_seconds, elapsed_seconds,
    (request_id % 100)::DOUBLE AS prompt_tokens, completion_tokens::DOUBLE AS completion_tokens FROM ({X.REQUESTS_SQL}) WHERE completion_tokens > 1)
  ON ttft_seconds, tpot_seconds, elapsed_seconds, prompt_tokens, completion_tokens INTO NAME c VALUE v),
  (VALUES ('count'), ('mean'), ('p50'), ('p95'), ('p99'), ('max')) m(x) GROUP BY c, m.x""")
def evaluation_summary(t):
    """All five timings, of requests with more than one token; the errors of all requests."""
    many = F.col("completion_tokens") > 1
    records = X.requests(t).withColumns({
        "tpot_seconds": tpot("elapsed_seconds", "ttft_seconds", "completion_tokens"), "prompt_tokens": F.col("request_id") % 100})
    timed = [F.when(many, F.col(c)).alias(c) for c in E.TIMINGS]
    return E.evaluation_summary(X.graded(t), records.select("error", *timed))
