"""Load-test queries: request logs, timings, waves, cases and artefacts."""

from pyspark.sql import functions as F

from evalweave.functions import cases as K
from evalweave.functions import metrics as M
from evalweave.functions import text as TX
from evalweave.operators import aggregates as A
from evalweave.operators import filters as FL
from evalweave.operators import joins as J
from evalweave.operators import ordering as O
from evalweave.operators import quantiles as Q
from evalweave.operators import sets as S
from evalweave.plans import evaluation as E
from evalweave.plans import matrix as MX
from evalweave.queries import fixtures as X
from evalweave.queries.registry import query
from evalweave.session import materialize, scratch_path
from evalweave.sources.files import read_chunk_log as read_chunk_log_of


def _acceptance(t):
    return X.acceptance_lines(t).select(
        "pos", "path", M.log_counter("line", "speculative_accepted_tokens").alias("accepted"),
        M.log_counter("line", "speculative_proposed_tokens").alias("proposed"))


RATE = "round(sum(accepted) * 100.0 / nullif(sum(proposed), 0), 6) AS rate, count(*) AS n"


@query("log_counter", X.COUNTS_SQL)
def log_counter(t):
    return _acceptance(t)


@query("valid_counts", f"SELECT pos, accepted, proposed FROM ({X.COUNTS_SQL}) WHERE accepted <= proposed")
def valid_counts(t):
    return FL.filter_valid_counts(_acceptance(t), "accepted", "proposed").drop("path")


@query("acceptance_rate", f"SELECT {RATE} FROM ({X.COUNTS_SQL}) WHERE accepted <= proposed")
def acceptance_rate(t):
    return A.acceptance_rate(_acceptance(t))


@query("acceptance_by_case", f"""
SELECT path, round(sum(accepted) FILTER (accepted <= proposed) * 100.0
                   / nullif(sum(proposed) FILTER (accepted <= proposed), 0), 6) AS rate,
       count(*) FILTER (accepted <= proposed) AS n
FROM ({X.COUNTS_SQL}) GROUP BY path""")
def acceptance_by_case(t):
    return A.acceptance_rate(_acceptance(t), "path")


OFFSETS_SQL = f"""
SELECT path, max(pos) // 2 AS "offset", CASE WHEN CAST(path AS BIGINT) % 5 = 0 THEN 0 ELSE max(pos) END AS size
FROM ({X.LINES_SQL}) GROUP BY path"""


@query("from_offset", f"""
SELECT l.path, l.pos FROM ({X.LINES_SQL}) l JOIN ({OFFSETS_SQL}) o ON l.path = o.path
WHERE l.pos >= CASE WHEN o.size >= o."offset" THEN o."offset" ELSE 0 END""")
def from_offset(t):
    lines = X.acceptance_lines(t).select("path", "pos")
    last = F.max("pos")
    offsets = lines.groupBy("path").agg(F.floor(last / 2).alias("offset"), last.alias("last")).select(
        "path", "offset", F.when(F.col("path").cast("bigint") % 5 == 0, 0).otherwise(F.col("last")).alias("size"))
    return J.from_offset(lines, offsets, "path", "pos")


@query("reconcile_counts", """
SELECT key, e.n AS expected, o.n AS observed, e.n IS DISTINCT FROM o.n AS mismatch
FROM (SELECT o_orderkey AS key, 4::BIGINT AS n FROM orders) e
FULL JOIN (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1) o USING (key)""")
def reconcile_counts(t):
    expected = t.orders.select(F.col("o_orderkey").alias("key"), F.lit(4).alias("n"))
    observed = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n"))
    return J.reconcile_counts(expected, observed, "key")


def _q(column, name):
    return (f"count({column}) AS count, round(avg({column}) + 1e-9, 6) AS mean, "
            f"round(quantile_cont({column}, 0.5) + 1e-9, 6) AS p50, round(quantile_cont({column}, 0.95) + 1e-9, 6) AS p95, "
            f"round(quantile_cont({column}, 0.99) + 1e-9, 6) AS p99, round(max({column}) + 1e-9, 6) AS max")


def _settled(df):
    """Ties in the seventh place, which engines break differently, go up on both sides."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c, kind in df.dtypes if kind == "double"})


@query("describe", " UNION ALL ".join(
    f"SELECT '{c}' AS metric, {_q(f'CAST({c} AS DOUBLE)', c)} FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def describe(t):
    return _settled(Q.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("describe_requests", " UNION ALL ".join(
    f"SELECT case_id, '{c}' AS metric, {_q(f'CAST({c} AS DOUBLE)', c)} FROM r GROUP BY case_id" if i else
    f"WITH r AS (SELECT *, CASE WHEN completion_tokens > 1 THEN (elapsed_seconds - ttft_seconds) / (completion_tokens - 1) END AS tpot_seconds FROM ({X.REQUESTS_SQL})) "
    f"SELECT case_id, '{c}' AS metric, {_q(f'CAST({c} AS DOUBLE)', c)} FROM r GROUP BY case_id"
    for i, c in enumerate(["completion_tokens", "ttft_seconds", "tpot_seconds", "elapsed_seconds"])))
def describe_requests(t):
    rows = X.requests(t).withColumn("tpot_seconds", M.tpot("elapsed_seconds", "ttft_seconds", "completion_tokens"))
    return _settled(Q.describe(rows, ["completion_tokens", "ttft_seconds", "tpot_seconds", "elapsed_seconds"], "case_id"))


NEAR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("sketch_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS metric, count({c}) AS count, max({c}) AS max, true AS p50, true AS p95, true AS p99 FROM lineitem"
    for c in NEAR))
def sketch_quantiles(t):
    """Sketches stored per return flag and merged; whether each percentile lies within the bound."""
    path = scratch_path(t.spark, "sketches")
    Q.sketch(t.lineitem, NEAR, "l_returnflag").write.parquet(path)
    merged = materialize(Q.described(Q.merge_sketches(t.spark.read.parquet(path))))
    values = t.lineitem.select(*NEAR).unpivot([], NEAR, "metric", "value").join(F.broadcast(merged), "metric")

    def near(name, p):
        below, upto = F.avg((F.col("value") < F.col(name)).cast("int")), F.avg((F.col("value") <= F.col(name)).cast("int"))
        return ((below <= p + Q.RANK_ERROR) & (upto >= p - Q.RANK_ERROR)).alias(name)

    return values.groupBy("metric", "count", "max").agg(near("p50", 0.5), near("p95", 0.95), near("p99", 0.99))


@query("parse_result", """
WITH m AS (SELECT user_id, {case} AS param, value, event_id FROM events WHERE user_id % 3 <> 0),
     c AS (SELECT user_id, round(sum(value), 6) AS a, round(avg(value), 6) AS b, count(*)::DOUBLE AS d FROM events GROUP BY 1)
SELECT 'run-' || m.user_id AS stem, {picks},
  any_value(a) AS total_tokens_per_s, any_value(b) AS requests_per_s, any_value(d) AS total_requests
FROM m JOIN c ON m.user_id = c.user_id GROUP BY m.user_id""".format(
    case="CASE event_type WHEN 'view' THEN 'E2EL' WHEN 'click' THEN 'TTFT' WHEN 'signup' THEN 'TPOT' WHEN 'purchase' THEN 'ITL' "
         "ELSE 'OutputTokenThroughput' END",
    picks=", ".join(f"arg_max(value, event_id) FILTER (param = '{p}') AS {c}" for c, p in A.C.SUMMARY_PARAMS.items())))
def parse_result(t):
    """Result tables of all runs, documents of two thirds of them."""
    stem = F.concat(F.lit("run-"), F.col("user_id"))
    rows = _metric_rows(t).withColumn("stem", stem).drop("user_id")
    common = _common_metrics(t).where(F.col("user_id") % 3 != 0).withColumn("stem", stem).withColumn("stage", F.lit("total")).drop("user_id")
    return E.parse_result(rows, common)


@query("metric_stats", """
SELECT event_type AS param, 'total' AS stage, round(avg(value), 6) AS average, min(value) AS min, max(value) AS max,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75,
       round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n
FROM events GROUP BY event_type""")
def metric_stats(t):
    rows = t.events.select(F.col("event_type").alias("param"), F.lit("total").alias("stage"), "value")
    return Q.metric_stats(rows, "param", "stage", "value")


PARAMS = {"view": "E2EL", "click": "TTFT", "signup": "TPOT", "purchase": "ITL", "error": "OutputTokenThroughput"}
PARAM_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PARAMS.items()) + " END"


@query("summary_wide", f"""
WITH m AS (SELECT user_id, {PARAM_CASE} AS param, value, event_id FROM events),
     c AS (SELECT user_id, round(sum(value), 6) AS a, round(avg(value), 6) AS b, count(*)::DOUBLE AS d FROM events GROUP BY 1)
SELECT m.user_id, {", ".join(
    f"arg_max(value, event_id) FILTER (param = '{p}') AS {c}" for c, p in A.C.SUMMARY_PARAMS.items())},
  any_value(a) AS total_tokens_per_s, any_value(b) AS requests_per_s, any_value(d) AS total_requests
FROM m JOIN c ON m.user_id = c.user_id GROUP BY m.user_id""")
def summary_wide(t):
    return A.summary_wide(_metric_rows(t), _common_metrics(t), "user_id")


def _metric_rows(t):
    kinds = F.create_map(*[F.lit(x) for kv in PARAMS.items() for x in kv])
    rows = t.events.select("user_id", F.element_at(kinds, F.col("event_type")).alias("param"),
                           F.format_string("%.12f ms", F.col("value")).alias("average"), F.col("event_id").alias("ord"),
                           F.lit("total").alias("stage"))
    other = rows.withColumns({"stage": F.lit("stable"), "average": F.lit("0 ms"), "ord": F.col("ord") + 10**9})
    return rows.unionByName(other)


def _common_metrics(t):
    return t.events.groupBy("user_id").agg(
        F.sum("value").alias("Total Token Throughput"), F.avg("value").alias("Request Throughput"),
        F.count("*").cast("double").alias("Total Requests")).unpivot(
        ["user_id"], ["Total Token Throughput", "Request Throughput", "Total Requests"], "metric", "value")


ROLL_SQL = f"""
WITH r AS (SELECT *, 1 << CAST(case_id % 4 AS INT) AS concurrency, completion_tokens AS output_tokens,
             request_id % 100 AS input_tokens,
             start + to_microseconds(CAST(round(elapsed_seconds * 1000000) AS BIGINT)) AS finish,
             CASE WHEN completion_tokens > 1 THEN (elapsed_seconds - ttft_seconds) / (completion_tokens - 1) END AS tpot
           FROM ({X.REQUESTS_SQL})),
 s AS (SELECT concurrency, count(*) AS requests, count(*) FILTER (ok) AS succeed, count(*) FILTER (NOT ok) AS failed,
         date_diff('microsecond', min(start), max(finish)) / 1e6 AS span,
         sum(output_tokens) FILTER (ok) AS o, sum(input_tokens) FILTER (ok) AS i,
         sum(greatest(output_tokens - 1, 0)) FILTER (ok) AS gaps,
         sum(elapsed_seconds - ttft_seconds) FILTER (ok AND output_tokens > 1) AS gap_s,
         avg(elapsed_seconds) FILTER (ok) AS l, avg(ttft_seconds) FILTER (ok) AS tt, avg(tpot) FILTER (ok) AS tp,
         avg(input_tokens) FILTER (ok) AS ai, avg(output_tokens) FILTER (ok) AS ao,
         quantile_cont(elapsed_seconds, 0.99) FILTER (ok) AS pl, quantile_cont(ttft_seconds, 0.99) FILTER (ok) AS pt,
         quantile_cont(tpot, 0.99) FILTER (ok) AS pp
       FROM r GROUP BY concurrency)
SELECT CAST(concurrency AS BIGINT) AS concurrency, requests, succeed, failed,
  round(succeed / span, 6) AS request_throughput, round(o / span, 6) AS output_token_throughput,
  round((o + i) / span, 6) AS total_token_throughput, round(l, 6) AS avg_latency_s, round(tt, 6) AS avg_ttft_s,
  round(tp, 6) AS avg_tpot_s, round(gap_s / gaps, 6) AS avg_itl_s, round(ai, 6) AS avg_input_tokens,
  round(ao, 6) AS avg_output_tokens, round(pl, 6) AS p99_latency_s, round(pt, 6) AS p99_ttft_s,
  round(pp, 6) AS p99_tpot_s
FROM s"""


def _rollup(t):
    rows = X.requests(t).withColumn("concurrency", F.expr("shiftleft(1L, cast(case_id % 4 as int))")).withColumn(
        "output_tokens", F.col("completion_tokens")).withColumn("input_tokens", F.col("request_id") % 100)
    return A.load_rollup(rows)


@query("load_rollup", ROLL_SQL)
def load_rollup(t):
    return _rollup(t)


WAVES_SQL = f"""
SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY request_id) - 1) // 8 + 1 AS wave,
       (row_number() OVER (PARTITION BY case_id ORDER BY request_id) - 1) % 8 AS slot
FROM ({X.REQUESTS_SQL})"""
WAVE_STATS_SQL = f"""
SELECT case_id, wave, count(*) FILTER (ok) AS ok, count(*) AS total,
       round(avg(elapsed_seconds) FILTER (ok), 6) AS avg_seconds,
       round(coalesce(avg(ttft_seconds) FILTER (ok), 0), 6) AS avg_ttft,
       count(*) FILTER (NOT ok) AS failed, arg_max(error, request_id) FILTER (NOT ok) AS last_error
FROM ({WAVES_SQL}) GROUP BY case_id, wave"""


def _waves(t):
    placed = O.running_total(X.requests(t), "request_id", "case_id", start="i", total="of")
    return placed.withColumn("wave", M.wave_of("i", F.lit(8))).withColumn("slot", M.slot_of("i", F.lit(8)))


@query("wave_number", f"""
SELECT case_id, request_id, wave, slot,
       CAST(ceil(count(*) OVER (PARTITION BY case_id) / 8.0) AS BIGINT) AS waves FROM ({WAVES_SQL})""")
def wave_number(t):
    return _waves(t).select("case_id", "request_id", "wave", "slot", F.ceil(F.col("of") / 8).alias("waves"))


@query("wave_stats", WAVE_STATS_SQL)
def wave_stats(t):
    return A.wave_stats(_waves(t), ["case_id", "wave"], "request_id")


@query("cold_warm_ratio", f"""
WITH w AS ({WAVE_STATS_SQL.replace("round(avg(elapsed_seconds) FILTER (ok), 6)", "avg(elapsed_seconds) FILTER (ok)")})
SELECT case_id, round(f, 6) AS first_avg, round(l, 6) AS last_avg, g AS good_waves,
       CASE WHEN g >= 2 AND l > 0 AND f >= 0.1 THEN round(f / l, 6) END AS ratio
FROM (SELECT case_id, arg_min(avg_seconds, wave) FILTER (ok > 0) AS f, arg_max(avg_seconds, wave) FILTER (ok > 0) AS l,
             count(*) FILTER (ok > 0) AS g FROM w GROUP BY case_id)""")
def cold_warm_ratio(t):
    return A.cold_warm_ratio(A.wave_stats(_waves(t), ["case_id", "wave"], "request_id"), "case_id")


@query("request_timing", f"""
SELECT request_id,
  round(date_diff('microsecond', min(started), min(ts) FILTER (piece <> '')) / 1e6, 6) AS ttft_seconds,
  round(date_diff('microsecond', min(started), max(ts)) / 1e6, 6) AS elapsed_seconds,
  count(*) FILTER (piece <> '') AS chunks,
  arg_max(finish_reason, seq) FILTER (finish_reason IS NOT NULL) AS finish_reason,
  arg_max(usage, seq) FILTER (usage IS NOT NULL) AS usage,
  CASE WHEN count(*) FILTER (piece <> '') = 0 THEN 'empty_response' END AS error
FROM ({X.CHUNKS_SQL}) GROUP BY request_id""")
def request_timing(t):
    return A.request_timing(X.chunks(t), "request_id", "seq", "started")


@query("read_chunk_log", f"""
WITH c AS (SELECT user_id AS request_id, event_id AS seq, event_type,
       min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
SELECT request_id, seq, CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS piece,
       CASE WHEN event_type = 'purchase' THEN 'stop' END AS finish_reason
FROM c WHERE stop IS NULL OR seq < stop""")
def read_chunk_log(t):
    kind = F.col("event_type")
    choice = F.struct(
        F.struct(F.when(kind != "signup", kind).alias("content")).alias("delta"),
        F.when(kind == "purchase", F.lit("stop")).alias("finish_reason"))
    body = F.when(kind == "error", F.lit("[DONE]")).otherwise(F.to_json(F.struct(F.array(choice).alias("choices"))))
    path = scratch_path(t.spark, "chunks")
    t.events.select(
        F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("data: "), body).alias("line")).write.json(path)
    return A.before_done(read_chunk_log_of(t.spark, path), "request_id", "seq").select(
        F.col("request_id").cast("bigint").alias("request_id"), "seq", "piece", "finish_reason")


@query("split_status", f"""
SELECT request_id, 'ok' AS status FROM ({X.REQUESTS_SQL}) WHERE ok
UNION ALL SELECT request_id, split_part(error, ':', 1) FROM ({X.REQUESTS_SQL}) WHERE NOT ok""")
def split_status(t):
    ok, failed = FL.split_status(X.requests(t), "ok")
    return ok.select("request_id", F.lit("ok").alias("status")).unionByName(
        failed.select("request_id", TX.error_category("error").alias("status")))


@query("validate_rows", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, array_to_string(list_filter([
   CASE WHEN NOT (l_quantity >= 5) THEN 'quantity below minimum' END,
   CASE WHEN NOT (l_tax <= l_discount) THEN 'min above max' END,
   CASE WHEN NOT (l_linenumber > 0) THEN 'line not positive' END], lambda x: x IS NOT NULL), ';') AS violations
FROM lineitem""")
def validate_rows(t):
    checked = FL.validate_rows(t.lineitem, {
        "quantity below minimum": F.col("l_quantity") >= 5, "min above max": F.col("l_tax") <= F.col("l_discount"),
        "line not positive": F.col("l_linenumber") > 0})
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("violations", ";").alias("violations"))


@query("tpot", f"""
SELECT request_id, floor(1e6 * CASE WHEN completion_tokens > 1
       THEN (elapsed_seconds - ttft_seconds) / (completion_tokens - 1) END) / 1e6 AS tpot FROM ({X.REQUESTS_SQL})""")
def tpot(t):
    # cut, not rounded: engines break ties in the seventh place differently
    cut = F.floor(M.tpot("elapsed_seconds", "ttft_seconds", "completion_tokens") * F.lit(1e6)) / F.lit(1e6)
    return X.requests(t).select("request_id", cut.alias("tpot"))


@query("retry_delay", """
SELECT event_id, round(least(2.0 * pow(2, a - 1), 60.0), 6) AS delay,
       round(coalesce(list_sum(list_transform(range(1, a), lambda i: least(2.0 * pow(2, i - 1), 60.0))), 0), 6) AS waited
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 + 1 AS a FROM events)""")
def retry_delay(t):
    a = X.k() % 9 + 1
    return t.events.select("event_id", M.retry_delay(a, 2.0, 60.0).alias("delay"),
                           M.total_retry_wait(a, 2.0, 60.0).alias("waited"))


@query("usage_tokens", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens,
       CAST(NULL AS BIGINT) AS prompt_tokens FROM events""")
def usage_tokens(t):
    return t.events.select("event_id", M.usage_tokens("props", "k").alias("completion_tokens"),
                           M.usage_tokens("props", "prompt_tokens").alias("prompt_tokens"))


@query("dedup_last", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def dedup_last(t):
    return O.dedup_last(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("latest_artifact", f"""
SELECT key, path, mtime FROM ({X.RUN_FILES_SQL})
QUALIFY row_number() OVER (PARTITION BY key ORDER BY mtime DESC, path DESC) = 1""")
def latest_artifact(t):
    return O.latest_artifact(X.run_files(t), "key")


@query("new_runs", """
SELECT DISTINCT o_custkey AS run FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'""")
def new_runs(t):
    runs = t.orders.select(F.col("o_custkey").alias("run"), "o_orderdate")
    return S.new_runs(runs.where("o_orderdate >= timestamp_ntz'1998-01-01'"),
                      runs.where("o_orderdate < timestamp_ntz'1996-01-01'"), "run")


@query("paired_runs", """
SELECT DISTINCT o_custkey AS stem FROM orders WHERE o_orderstatus = 'F'
  AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def paired_runs(t):
    stems = t.orders.select(F.col("o_custkey").alias("stem"), "o_orderstatus")
    return J.paired_runs(stems.where("o_orderstatus = 'F'").select("stem").distinct(),
                         stems.where("o_orderstatus = 'P'"))


@query("latest_new_run", """
SELECT max(run) AS run FROM (
  SELECT o_custkey AS run, o_orderpriority AS stem FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
WHERE run NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') HAVING max(run) IS NOT NULL""")
def latest_new_run(t):
    kind = F.when(F.col("o_orderstatus") == "F", "csv").when(F.col("o_orderstatus") == "O", "json")
    files = t.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("stem"), kind.alias("kind"))
    before = t.orders.where("o_orderdate < timestamp_ntz'1995-06-01'").select(F.col("o_custkey").alias("run"))
    return S.latest_new_run(files, before)


WORDS_SQL = "list_filter(regexp_split_to_array(replace(l_returnflag || ',' || l_linestatus || ' ' || l_returnflag || CAST(l_linenumber AS VARCHAR), ' ', ','), ','), lambda x: x <> '')"


@query("ordered_distinct", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  CASE WHEN w[1] = w[2] THEN w[1] || ' ' || w[3] ELSE w[1] || ' ' || w[2] || ' ' || w[3] END AS words,
  array_to_string(list_sort(list_filter(list_distinct(w), lambda x: x NOT IN ('A','F','N','O'))), ' ') AS unknown
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {WORDS_SQL} AS w FROM lineitem)""")
def ordered_distinct(t):
    text = F.concat("l_returnflag", F.lit(","), "l_linestatus", F.lit(" "), "l_returnflag", F.col("l_linenumber").cast("string"))
    allowed = F.array(*[F.lit(x) for x in "AFNO"])
    rows = t.lineitem.withColumn("__t", text)
    words, unknown = S.ordered_distinct("__t", allowed)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey",
                       F.array_join(words, " ").alias("words"), F.array_join(unknown, " ").alias("unknown"))


@query("unknown_values", """
SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN '' ELSE lang END AS unknown FROM documents""")
def unknown_values(t):
    allowed = F.array(F.lit("en"), F.lit("de"))
    return t.documents.select("doc_id", F.array_join(
        TX.unknown_values(F.array("lang"), allowed), " ").alias("unknown"))


@query("order_by_concurrency", """
SELECT event_id, c, row_number() OVER (ORDER BY coalesce(c, 0), event_id) AS rank
FROM (SELECT event_id, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7, 3) AS c FROM events)""")
def order_by_concurrency(t):
    rows = t.events.select("event_id", F.nullif(X.k() % 7, F.lit(3)).alias("c"))
    return A.order_by_concurrency(rows, "c", "event_id")


def _matrix(t):
    return MX.workload_matrix(X.cases(t), X.LENGTHS, X.CONCURRENCIES, X.PREFIX_SHARES)


@query("workload_matrix", X.MATRIX_SQL)
def workload_matrix(t):
    return _matrix(t)


@query("dataset_info", """
SELECT s_suppkey AS ord, dataset_type, CASE dataset_type WHEN 'gsm' THEN 'GSM8K' WHEN 'sharegpt' THEN 'ShareGPT' ELSE 'Swebench' END AS display_name,
  CASE dataset_type WHEN 'gsm' THEN 'GSM8K-in' WHEN 'sharegpt' THEN 'ShareGPT-in' ELSE 'Swebench-in' END AS artifact_prefix
FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'gsm' WHEN 1 THEN 'sharegpt' WHEN 2 THEN 'swebench' END AS dataset_type FROM supplier)
WHERE dataset_type IS NOT NULL""")
def dataset_info(t):
    return J.dataset_info(X.cases(t))


@query("unknown_datasets", "SELECT s_suppkey AS ord, 'other' AS dataset_type FROM supplier WHERE s_suppkey % 4 = 3")
def unknown_datasets(t):
    return J.unknown_datasets(X.cases(t))


@query("active_types", f"SELECT DISTINCT dataset_type FROM ({X.CASES_SQL})")
def active_types(t):
    return A.active_types(X.cases(t))


@query("artifact_name", f"""
SELECT seq, artifact, regexp_replace(artifact, '\\.jsonl$', '') || '-' || concurrency || '并发' AS case_name
FROM ({X.NAMED_SQL})""")
def artifact_name(t):
    rows = J.dataset_info(_matrix(t)).withColumn("n", M.sample_count("concurrency"))
    rows = rows.withColumn("artifact", K.artifact_name("artifact_prefix", "input_len", "n", "pfx"))
    return rows.select("seq", "artifact", K.case_name("artifact", "concurrency").alias("case_name"))


MANIFEST_SQL = "SELECT 'GSM8K-in64-bs' || p_size * 10 || '.jsonl' AS artifact FROM part"


def _manifest(t):
    return t.part.select(F.concat(F.lit("GSM8K-in64-bs"), F.col("p_size") * 10, F.lit(".jsonl")).alias("artifact"))


@query("build_plan", f"""
SELECT DISTINCT dataset_type, input_len, concurrency * 10 AS samples, pfx, artifact FROM ({X.NAMED_SQL})
WHERE artifact NOT IN ({MANIFEST_SQL})""")
def build_plan(t):
    return MX.build_plan(_matrix(t), _manifest(t))


@query("missing_artifacts", f"""
SELECT 'GSM8K-in64-bs' || l_linenumber * 10 || CASE WHEN l_quantity > 25 THEN '-pfx85' ELSE '' END || '.jsonl' AS artifact,
       count(*) AS n FROM lineitem GROUP BY 1 HAVING artifact NOT IN ({MANIFEST_SQL})""")
def missing_artifacts(t):
    name = K.artifact_name(F.lit("GSM8K-in"), F.lit(64), F.col("l_linenumber") * 10,
                           F.when(F.col("l_quantity") > 25, 85))
    planned = t.lineitem.groupBy(name.alias("artifact")).agg(F.count("*").alias("n"))
    return J.missing_artifacts(planned, _manifest(t))


STATUS_SQL = f"SELECT *, CASE WHEN seq % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM ({X.MATRIX_SQL})"


@query("group_results", f"""
SELECT dataset_type, input_len, pfx, count(*) AS cases, count(*) FILTER (status = 'ok') AS ok,
       count(*) FILTER (status <> 'ok') AS failed FROM ({STATUS_SQL}) GROUP BY ALL""")
def group_results(t):
    rows = _matrix(t).withColumn("status", F.when(F.col("seq") % 5 == 0, "failed").otherwise("ok"))
    return A.group_results(rows)


CASE_TEXT_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount,
  CASE l_linenumber % 4 WHEN 0 THEN 'GSM:' WHEN 1 THEN 'swebench:' ELSE '' END
  || l_partkey || '-' || CASE WHEN l_suppkey % 11 = 0 THEN 'x' ELSE CAST(l_suppkey AS VARCHAR) END || '-' || l_linenumber
  || CASE WHEN l_returnflag = 'R' THEN '' ELSE '-' || CAST(l_linenumber AS VARCHAR) || '.5' END
  || CASE WHEN l_returnflag = 'A' THEN '-' || (l_partkey % 3) * 10 ELSE '' END AS txt
FROM lineitem"""


def _case_text(t):
    n = F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "GSM:").when(n % 4 == 1, "swebench:").otherwise("")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(
        kind, "l_partkey", F.lit("-"), F.when(F.col("l_suppkey") % 11 == 0, "x").otherwise(F.col("l_suppkey").cast("string")),
        F.lit("-"), n, F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("-"), n, F.lit(".5"))),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("-"), (F.col("l_partkey") % 3) * 10)).otherwise("")).alias("txt"))


@query("parse_case", f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  CASE l_linenumber % 4 WHEN 0 THEN 'gsm' WHEN 1 THEN 'swebench' ELSE 'sharegpt' END AS dataset_type,
  l_partkey AS input_len, CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey END AS out_len,
  CAST(l_linenumber AS BIGINT) AS concurrency,
  CASE WHEN l_returnflag <> 'R' THEN CAST(l_linenumber AS DOUBLE) + 0.5 END AS request_rate,
  CASE WHEN l_returnflag = 'A' THEN nullif((l_partkey % 3) * 10, 0) END AS pfx,
  CASE WHEN l_returnflag = 'R' THEN 'too few fields' WHEN l_suppkey % 11 = 0 THEN 'bad number' END AS reject_reason
FROM ({CASE_TEXT_SQL})""")
def parse_case(t):
    return K.parse_cases(_case_text(t), "txt").select("l_orderkey", "l_linenumber", "l_partkey", "case.*")


@query("sample_count", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_linenumber * greatest(CAST(l_quantity AS BIGINT) % 12, 1) AS BIGINT) AS samples,
  CAST(greatest(20, l_linenumber * 10) AS BIGINT) AS auto_samples FROM lineitem""")
def sample_count(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        M.sample_count("l_linenumber", F.col("l_quantity").cast("bigint") % 12).alias("samples"),
        M.auto_sample_count("l_linenumber").alias("auto_samples"))


@query("prefix_lengths", """
SELECT p_partkey, shared AS prefix_len, p_size * 64 - shared AS suffix_len
FROM (SELECT p_partkey, p_size, (p_size * 64) * (p_partkey % 101) // 100 AS shared FROM part)
WHERE shared > 0 AND shared < p_size * 64""")
def prefix_lengths(t):
    length = F.col("p_size").cast("bigint") * 64
    rows = t.part.select("p_partkey", length.alias("l"), (F.col("p_partkey") % 101).alias("p"))
    rows = rows.withColumn("prefix_len", M.prefix_length("l", "p")).where("prefix_len is not null")
    return rows.select("p_partkey", "prefix_len", (F.col("l") - F.col("prefix_len")).alias("suffix_len"))


@query("warmup_total", """
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5
  ELSE (p_size % 4) * greatest(coalesce(nullif(p_partkey % 3, 0), p_size), 1) END AS total FROM part""")
def warmup_total(t):
    rows = t.part.select("p_partkey", (F.col("p_partkey") % 5).alias("requests"), (F.col("p_size") % 4).alias("rounds"),
                         (F.col("p_partkey") % 3).alias("slots"), F.col("p_size").cast("bigint").alias("c"))
    return rows.select("p_partkey", M.warmup_total("requests", "rounds", "slots", "c").alias("total"))


@query("format_rate", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'na'
   WHEN l_quantity / 8 = floor(l_quantity / 8) THEN CAST(CAST(l_quantity / 8 AS BIGINT) AS VARCHAR)
   ELSE printf('%g', l_quantity / 8) END AS rate FROM lineitem""")
def format_rate(t):
    rate = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") / 8)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", TX.format_rate(rate).alias("rate"))
