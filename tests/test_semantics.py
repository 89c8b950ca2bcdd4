"""Small cases in which a plausible implementation goes wrong."""

from datetime import datetime

from pyspark.sql import functions as F

from evalweave.functions.cases import parse_cases
from evalweave.functions.messages import decode_chunk
from evalweave.operators import aggregates as A
from evalweave.operators import joins as J
from evalweave.operators import ordering as O
from evalweave.plans import prompt_sets as P
from evalweave.sinks.writers import write_result_groups
from evalweave.sources import files as S


def test_cases_lose_white_space_of_any_kind(spark):
    df = spark.createDataFrame([("\tgsm:1-2-3-0.5\n",)], "c string")
    case = parse_cases(df, "c").first().case
    assert (case.dataset_type, case.input_len, case.request_rate, case.reject_reason) == ("gsm", 1, 0.5, None)


def test_end_mark_with_carriage_return(spark):
    assert spark.range(1).select(decode_chunk(F.lit("data: [DONE]\r")).alias("d")).first().d.done


def test_repeated_right_sides_multiply_nothing(spark):
    problems = spark.createDataFrame([("a",), ("b",)], "id string")
    grades = spark.createDataFrame([("a", True), ("a", True)], "id string, passed boolean")
    state = spark.createDataFrame([("a", "x"), ("a", "x")], "id string, parsed_code string")
    assert sorted(map(tuple, J.attach_grade(problems, grades, "id").collect())) == [("a", True), ("b", False)]
    assert sorted(map(tuple, J.attach_state(problems, state, "id").collect())) == [("a", "x"), ("b", "")]
    runs = spark.createDataFrame([("r", 1.0)], "run_dir string, latency double")
    p99 = spark.createDataFrame([("r", "99%", 1.0), ("r", "99%", 2.0)], "run_dir string, percentile string, ttft double").coalesce(1)
    assert list(map(tuple, J.attach_p99(runs, p99).collect())) == [("r", 1.0, 1.0)]


def test_summary_takes_the_total_stage(spark):
    rows = spark.createDataFrame([("c", "TTFT", "total", "5 ms", 1), ("c", "TTFT", "stable", "7 ms", 2)],
                                 "case string, param string, stage string, average string, ord int")
    common = spark.createDataFrame([("c", "Total Requests", "stable", "7"), ("c", "Total Requests", "total", "9")],
                                   "case string, metric string, stage string, value string")
    got = A.summary_wide(rows, common, "case").first()
    assert (got.avg_ttft_ms, got.total_requests) == (5.0, 9.0)


def test_first_token_counts_from_the_request(spark):
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    chunks = spark.createDataFrame([(1, 1, t(5), t(0), "a", None, None), (1, 2, t(8), t(0), "b", "stop", None)],
                                   "id int, seq int, ts timestamp_ntz, sent timestamp_ntz, piece string, finish_reason string, usage string")
    assert A.request_timing(chunks, "id", "seq", "sent").first()[1:3] == (5.0, 8.0)
    assert A.request_timing(chunks, "id", "seq").first()[1:3] == (0.0, 3.0)


def test_history_holds_human_turns_only(spark):
    turns = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "bb"), (1, 2, "human", "c")],
                                  "conv_id bigint, turn bigint, role string, text string")
    last = lambda mode: O.turn_requests(turns, "human", mode).where("turn = 2").first()
    assert (last("every").history_turns, last("every").history_chars) == (1, 1)
    assert (last("every_with_gt").history_turns, last("every_with_gt").history_chars) == (2, 3)


def test_builders_take_any_key(spark):
    corpus = spark.createDataFrame([(f"k{n:02d}", " ".join(f"w{n}" for _ in range(n + 1))) for n in range(12)], "id string, text string")
    numbered = corpus.withColumn("n", F.substring("id", 2, 2).cast("bigint"))
    for build in (lambda c, k: P.build_concat(c, k, "text", 7), lambda c, k: P.build_prefix(c, k, "text", 8, 50),
                  lambda c, k: P.build_tiled(c, k, "text", 5, 30).drop(k), lambda c, k: P.build_concat(c, k, "text", 7, 25)):
        a, b = build(corpus, "id"), build(numbered, "n")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    kept = O.limit_per_group(corpus.withColumn("g", F.lit(1)), "g", "id", 3)
    assert sorted(r.id for r in kept.collect()) == ["k00", "k01", "k02"]


def test_file_order_over_files_and_blocks(spark, tmp_path):
    for name, part in (("b", range(500, 900)), ("a", range(500))):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"question": "q{n}"}}\n' for n in part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = S.read_questions(spark, str(tmp_path)).orderBy("ord").collect()
        assert [r.question for r in rows] == [f"q{n}" for n in range(900)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_result_groups_have_few_files(spark, tmp_path):
    rows = spark.range(160).select((F.col("id") % 5).cast("string").alias("dataset_type"), (F.col("id") % 3).alias("input_len"),
                                   F.lit(0).alias("pfx"), F.col("id").alias("seq")).repartition(16)
    write_result_groups(rows, rows, str(tmp_path / "r"))
    files = list((tmp_path / "r" / "summary").rglob("*.parquet"))
    assert 15 <= len(files) <= 60 and spark.read.parquet(str(tmp_path / "r" / "summary")).count() == 160
