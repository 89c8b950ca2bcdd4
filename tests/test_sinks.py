"""Writers round-trip through readers."""

from pyspark.sql import functions as F

from evalweave.sinks import writers as W
from evalweave.sources import files as S
from tests.test_sources import CHATS, put, rows


def test_prompt_set_is_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "set.jsonl")
    W.write_prompt_set(spark.createDataFrame([("a",), ("b",)], "q string"), "q", path)
    W.write_prompt_set(spark.createDataFrame([("c",)], "q string"), "q", path)
    assert rows(S.read_questions(spark, path).select("question")) == [("a",), ("b",)]
    assert rows(spark.read.schema("answer string").json(path)) == [("none",), ("none",)]


def test_summary_csv_and_json(spark, tmp_path):
    rows_ = spark.createDataFrame([("overall", "all", 1, 3, 1 / 3)], "scope string, name string, passed int, total int, pass_at_1 double")
    W.write_summary(rows_, str(tmp_path / "s"), ["scope", "name", "pass_at_1"])
    assert spark.read.csv(str(tmp_path / "s/csv"), header=True).columns == ["scope", "name", "pass_at_1"]
    assert spark.read.json(str(tmp_path / "s/json")).first().name == "all"
    sub = W.subset_summary(spark.createDataFrame([("x", 3, 1 / 3)], "name string, num int, score double")).first()
    assert tuple(sub) == ("x", 3, "0.333333")


def test_result_groups_keep_failed_cases(spark, tmp_path):
    cases = spark.createDataFrame([("gsm", 64, None, "a", "ok", 1.0), ("gsm", 64, 85, "b", "failed", None)],
                                  "dataset_type string, input_len bigint, pfx bigint, case_name string, status string, avg_ttft_ms double")
    details = cases.select("dataset_type", "input_len", "pfx", "case_name", F.lit("TTFT").alias("param"))
    W.write_result_groups(cases, details, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r/summary"))
    assert rows(back.where("pfx = 85").select("case_name", "avg_ttft_ms")) == [("b", None)]
    assert rows(back.where("pfx is null").select("case_name")) == [("a",)]


def test_chat_subset_round_trip(spark, tmp_path):
    chats = S.read_nested_chats(spark, put(tmp_path / "c.json", CHATS))
    W.write_chat_subset(chats, str(tmp_path / "out"))
    back = S.read_nested_chats(spark, str(tmp_path / "out"), multi_line=False)
    assert rows(S.chat_turns(back)) == rows(S.chat_turns(chats))


def test_predictions(spark, tmp_path):
    attached = spark.createDataFrame([("q", "print(1)"), ("r", "")], "question_id string, parsed_code string")
    W.write_predictions(attached, "question_id", str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p/predictions"))
    assert rows(back.select("question_id", F.to_json("code_list"))) == [("q", '["print(1)"]'), ("r", '[""]')]
