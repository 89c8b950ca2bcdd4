"""Readers on small hand-made files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalweave.functions.messages import decode_chunk, flatten_messages, score_value
from evalweave.operators import aggregates as A
from evalweave.operators import filters as FL
from evalweave.operators import joins as J
from evalweave.operators import ordering as O
from evalweave.operators import sets as ST
from evalweave.plans.prompt_sets import multiturn_chats
from evalweave.queries import QUERIES
from evalweave.sinks import writers as WR
from evalweave.sources import files as S


READ_CASES, READ_COMMON = S.read_cases, S.read_common_metrics


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chat(*turns):
    return {"id": "c", "conversations": [{"from": r, "value": v} for r, v in turns]}


CHATS = [
    chat(("human", "hi"), ("gpt", "yes"), ("human", " "), ("gpt", "no")),
    chat(("human", ""), ("gpt", "odd"), ("human", "later")),
    chat(("system", "s"), ("human", "x")),
    {"id": "e"},
]


def test_questions(spark, tmp_path):
    path = put(tmp_path / "q.jsonl", '{"question": "a", "answer": "1"}\n{"question": "b"}\n')
    assert rows(S.read_questions(spark, path).select("question")) == [("a",), ("b",)]


def test_chats(spark, tmp_path):
    path = put(tmp_path / "c.json", CHATS)
    texts = [r.text for r in S.read_chats(spark, path).collect()]
    assert sorted(texts) == ["hi", "later", "x"]
    assert S.read_chats(spark, path, "all").count() == 7
    with pytest.raises(ValueError):
        S.read_chats(spark, put(tmp_path / "empty.json", []))


def test_prompts_first_human_turn_or_question(spark, tmp_path):
    chats = put(tmp_path / "c.json", CHATS)
    assert rows(S.read_prompts(spark, chats).select("prompt")) == [("hi",), ("x",)]
    lines = put(tmp_path / "p.jsonl", '{"question": "", "prompt": "b"}\n\n{"question": "a"}\n{"prompt": ""}\n')
    assert rows(S.read_prompts(spark, lines).select("prompt")) == [("a",), ("b",)]
    assert [r.prompt for r in S.read_prompts(spark, lines, 1).collect()] == ["b"]  # the first of the file


def test_nested_multiturn_and_requests(spark, tmp_path):
    chats = S.read_nested_chats(spark, put(tmp_path / "c.json", CHATS))
    valid = multiturn_chats(chats, "human")
    assert valid.count() == 1
    every = O.expand_requests(valid, "human", "every_with_gt")
    got = {(r.pos, r.prompt, tuple(h["value"] for h in r.history), r.gold) for r in every.collect()}
    assert got == {(0, "hi", (), "yes"), (2, " ", ("hi", "yes"), "no")}
    last = O.expand_requests(valid, "human", "last").collect()
    assert [(r.pos, [h["value"] for h in r.history]) for r in last] == [(2, ["hi"])]


def test_issues(spark, tmp_path):
    spark.createDataFrame([("i", "text"), ("j", " ")], "instance_id string, problem_statement string").write.parquet(
        str(tmp_path / "d" / "data"))
    assert rows(S.read_issues(spark, str(tmp_path / "d")).select("text")) == [("text",)]
    spark.createDataFrame([(7,)], "n bigint").write.parquet(str(tmp_path / "n"))
    assert rows(S.read_issues(spark, str(tmp_path / "n")).select("text")) == [("7",)]


def problem(qid, date="2024-01-02T00:00:00", **kw):
    return json.dumps({"question_id": qid, "question_title": "t", "platform": "p", "difficulty": "Easy",
                       "contest_date": date, **kw})


def test_problem_bank(spark, tmp_path):
    lines = [problem("a"), "", problem("b", question_title="first"), "{broken", '{"question_id": "x"}',
             problem("b", question_title="second"), "   "]
    bank = S.read_problems(spark, put(tmp_path / "bank.jsonl", "\n".join(lines) + "\n"))
    good = bank.where("not malformed")
    first = O.dedup_first(good, "question_id", "src_ord")
    assert rows(first.select("question_id", "question_title")) == [("a", "t"), ("b", "first")]
    bank = bank.withColumns({"completed": F.lit(True), "content": F.lit("x"), "parsed": F.lit(True)})
    counts = A.completeness(bank, F.col("question_id"), F.col("malformed")).first()
    # malformed rows count as duplicates
    assert (counts.rows, counts.unique, counts.duplicate_ids) == (5, 2, 3)
    assert FL.filter_values(first, "difficulty", ["EASY"]).count() == 2


def test_bank_must_parse(spark):
    def error(*flags):
        df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "line_no int, malformed boolean")
        return FL.check_parseable(df).first().error

    assert (error(), error(True, False), error(False, True)) == ("empty", "unparseable", None)


def test_metric_rows_and_summary(spark, tmp_path):
    csv = ("Performance Parameters,Stage,Average,Min,Max,Median,P75,P90,P99,N\n"
           "E2EL,total,25282.1 ms,1 ms,2 ms,1 ms,1 ms,1 ms,1 ms,4\n"
           " ,total,1,1,1,1,1,1,1,1\n"
           "OutputTokenThroughput,total,40.5053 token/s,1,1,1,1,1,1,4\n"
           "E2EL,total,7 ms,1,1,1,1,1,1,4\n")
    put(tmp_path / "run" / "r.csv", csv)
    put(tmp_path / "run" / "r.json", {"Total Requests": {"total": 4, "other": 5},
                                      "Request Throughput": {"total": "0.0396 req/s"}, "Empty": {}})
    put(tmp_path / "run" / "lone.csv", csv)
    metrics = S.read_metric_rows(spark, str(tmp_path / "run" / "*.csv"))
    common = S.read_common_metrics(spark, str(tmp_path / "run" / "*.json"))
    assert rows(common.select("metric", "stage", "value"))[1:] == [
        ("Request Throughput", "total", "0.0396 req/s"), ("Total Requests", "other", "5"), ("Total Requests", "total", "4")]
    paired = J.paired_runs(metrics, common)
    assert (metrics.count(), paired.count()) == (6, 3)
    from evalweave.functions.text import parse_number

    wide = A.summary_wide(paired.withColumn("average", parse_number("average")),
                          common.withColumn("value", parse_number("value")), "stem").first()
    assert (wide.avg_e2el_ms, wide.avg_ttft_ms, wide.avg_output_tokens_per_s) == (7.0, None, 40.5053)
    assert (wide.requests_per_s, wide.total_requests, wide.total_tokens_per_s) == (0.0396, 4.0, None)


def test_run_summaries_with_p99(spark, tmp_path):
    for c, p99 in ((1, [{"Percentiles": "50%", "TTFT (s)": 1}, {"Percentiles": "99%", "TTFT (s)": 9.5}]), (8, None), (16, "{bad")):
        put(tmp_path / f"parallel_{c}" / "benchmark_summary.json",
            {"Number of concurrency": c, "Total requests": 20, "Average latency (s)": 1.5})
        if p99 is not None:
            put(tmp_path / f"parallel_{c}" / "benchmark_percentile.json", p99)
    runs = J.attach_p99(S.read_run_summaries(spark, str(tmp_path)), S.read_percentiles(spark, str(tmp_path)))
    got = rows(runs.select("concurrency", "requests", "avg_latency_s", "p99_ttft_s"))
    assert got == [(1.0, 20.0, 1.5, 9.5), (8.0, 20.0, 1.5, None), (16.0, 20.0, 1.5, None)]


def test_eval_reports(spark, tmp_path):
    put(tmp_path / "a" / "r.json", {"metrics": [{"score": {"acc": 0.5, "z": 1}, "categories": [
        {"name": ["x", "y"], "num": 9, "score": 1, "subsets": [{"name": "s", "num": 3, "score": {"z": 0.25, "a": 1}}]},
        {"name": "plain", "subsets": []}]}]})
    put(tmp_path / "b" / "r.json", {"metrics": [{"score": 0.75, "macro_score": 0.5, "num": 7, "categories": [
        {"name": ["x", "y"], "num": 4, "score": None}, {"name": "plain", "num": 2, "score": 1}]}]})
    put(tmp_path / "c" / "r.json", {"score": 0.125})
    reports = S.read_eval_reports(spark, str(tmp_path))
    got = {r.report.split("/")[-2]: (r.score, r.macro_score, r.num) for r in reports.collect()}
    assert got == {"a": (0.5, 0.5, 3), "b": (0.75, 0.5, 7), "c": (0.125, 0.125, 0)}
    subsets = rows(S.subset_rows(reports).select("name", "num", "score"))
    assert subsets == [("plain", 2, 1.0), ("s", 3, 0.25), ("x/y", 4, 0.0)]
    weighted = A.combine_scores(S.subset_rows(reports)).first()
    assert (weighted.num, round(weighted.macro_score, 6)) == (9, round((1 + 0.25 + 0) / 3, 6))


def test_cases(spark, tmp_path):
    path = put(tmp_path / "cases.json", {
        "10": "gsm:64-8-1-0.5", "2": "32768-1024-4-0.5-90", "3": {"in": 5, "out_len": 6, "c": 2, "rate": 1.5, "pfx": 0, "ds": "gsm"},
        "4": "1-2-3", "5": 7, "6": "1-2-x-0", "7": "1-2-3-4-0", "8": "1-2-3-4-q"})
    got = {r.seq: tuple(r)[1:] for r in S.read_cases(spark, path).collect()}
    assert got["10"] == ("gsm", 64, 8, 1, 0.5, None, None)
    assert got["2"] == ("sharegpt", 32768, 1024, 4, 0.5, 90, None)
    assert got["3"] == ("gsm", 5, 6, 2, 1.5, 0, None)  # the object form keeps 0
    assert got["7"][5:] == (None, None)
    assert [got[k][-1] for k in "4568"] == ["too few fields", "neither text nor object", "bad number", "bad prefix share"]
    listed = S.read_cases(spark, put(tmp_path / "list.json", ["8-8-1-0", {"id": "z", "in": 1, "out": 2}]))
    assert rows(listed.select("seq", "input_len")) == [("1", 8), ("z", 1)]
    ranked = A.order_case_keys(spark.createDataFrame([(k,) for k in got], "key string"), "key")
    assert [r.key for r in ranked.orderBy("rank").collect()] == ["2", "3", "4", "5", "6", "7", "8", "10"]


def test_packed_cases_are_those_of_files(spark, tmp_path):
    """Of 40 documents, no 40 files are written or opened."""
    docs = {f"run={k}/cases.json": json.dumps({"a": f"gsm:{k}-8-1-0.5", "b": {"in": k, "out": 2, "id": "x\ny"}, "c": 7}, indent=1) for k in range(39)}
    docs["run=39/cases.json"] = '["8-8-1-0", {"in": 1'
    for name, doc in docs.items():
        put(tmp_path / "files" / name, doc)
    df = spark.createDataFrame(list(docs.items()), "name string, doc string").repartition(2)
    WR.write_packed(df, F.col("name"), "doc", str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.json"))) == 2
    packed = S.read_cases(spark, str(tmp_path / "packed"), packed=True)
    packed = packed.withColumn("run", F.regexp_extract("file_path", "run=([0-9]+)/", 1).cast("int"))
    files = S.read_cases(spark, str(tmp_path / "files"))
    assert len(rows(files)) == 117 and rows(files) == rows(packed.select(files.columns))


def test_query_writes_few_files_for_many_cases(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "read_cases", lambda spark, path, **how: seen.append(path) or READ_CASES(spark, path, **how))
    suppliers = spark.range(300).select(F.col("id").alias("s_suppkey"))
    suppliers.coalesce(3).write.parquet(str(tmp_path / "supplier.parquet"))
    got = QUERIES["read_cases"](spark, str(tmp_path))
    assert (got.count(), got.select("s_suppkey").distinct().count()) == (900, 300)
    assert len(list(Path(seen[0].removeprefix("file:")).rglob("part-*"))) <= 3


def test_packed_metrics_are_those_of_files(spark, tmp_path):
    docs = {f"r{k}/m.{k}.json": json.dumps({"Total Requests": {"total": k, "other": None}, "Empty": {}}, indent=1) for k in range(30)}
    for name, doc in docs.items():
        put(tmp_path / "files" / name, doc)
    df = spark.createDataFrame(list(docs.items()), "name string, doc string").repartition(2)
    WR.write_packed(df, F.concat(F.lit(f"file:{tmp_path}/files/"), "name"), "doc", str(tmp_path / "packed"))
    packed, files = S.read_common_metrics(spark, str(tmp_path / "packed"), packed=True), S.read_common_metrics(spark, f"{tmp_path}/files/*")
    assert packed.columns == files.columns and packed.count() == 90
    assert sorted(map(str, files.collect())) == sorted(map(str, packed.collect()))


def test_query_writes_few_files_for_many_users(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "read_common_metrics", lambda spark, path, **how: seen.append(path) or READ_COMMON(spark, path, **how))
    events = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 300).alias("user_id"))
    events.coalesce(3).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["read_common_metrics"](spark, str(tmp_path))
    assert (got.count(), got.select("user_id").distinct().count()) == (1200, 300)
    folder = Path(seen[0].removeprefix("file:").rstrip("*"))
    assert len(list(folder.rglob("part-*"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_chunk_log_ends_at_done(spark, tmp_path):
    def data(**delta):
        return "data: " + json.dumps({"choices": [{"delta": delta}]})

    lines = [": ping", data(role="a"), data(content="He"), "data: {bad", data(content=""), data(content="y"),
             'data: {"choices": [], "usage": {"completion_tokens": 2}}', "data: [DONE]", data(content="after")]
    path = put(tmp_path / "log.json", "\n".join(json.dumps(
        {"request_id": "r", "seq": i, "ts": f"2024-01-01T00:00:0{i}", "line": line}) for i, line in enumerate(lines)))
    chunks = A.before_done(S.read_chunk_log(spark, path), "request_id", "seq")
    timing = A.request_timing(chunks, "request_id", "seq").first()
    assert (timing.ttft_seconds, timing.elapsed_seconds, timing.chunks, timing.error) == (2.0, 6.0, 2, None)
    assert json.loads(timing.usage) == {"completion_tokens": 2}


def test_chunk_and_message_shapes(spark):
    df = spark.createDataFrame([("plain",), ('[{"content": "a"}, {"content": [{"text": "b"}, "c"]}, {}]',)], "m string")
    assert rows(df.select(flatten_messages("m"))) == [("a\n\nb\nc\n\n",), ("plain",)]
    line = spark.range(1).select(decode_chunk(F.lit("event: x")).alias("d")).first().d
    assert (line.done, line.piece) == (False, None)
    scores = spark.createDataFrame([("0.5",), ('{"b": 2, "a": 1}',), ("{}",), (None,)], "s string")
    assert sorted(r[0] for r in scores.select(score_value("s")).collect()) == [0.0, 0.0, 0.5, 2.0]


def test_newest_new_run_with_both_files(spark):
    files = spark.createDataFrame([
        ("r1", "a", "csv"), ("r1", "a", "json"), ("r2", "a", "csv"), ("r2", "a", "json"),
        ("r3", "a", "csv"), ("r3", "b", "json")], "run string, stem string, kind string")
    before = spark.createDataFrame([("r1",)], "run string")
    assert rows(ST.latest_new_run(files, before)) == [("r2",)]
    assert rows(ST.latest_new_run(files.where("run = 'r1'"), before)) == []
