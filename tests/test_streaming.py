"""State upserts and stream/batch agreement."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evalweave.operators.aggregates import acceptance_rate
from evalweave.operators.joins import pending
from evalweave.queries.fixtures import acceptance_lines
from evalweave.queries.registry import Tables
from evalweave.sinks.commits import Conflict, put_if_absent
from evalweave.sinks.tables import current_version, read_table, remove_old, replace_table
from evalweave.sources.logs import acceptance_counts
from evalweave.streaming import state as S
from evalweave.streaming.acceptance import RESULT, run_available
from tests.conftest import SMALL


def rec(qid, seq, **values):
    return {"question_id": qid, "seq": seq, "completed": True, "request_failed": False, **values}


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_upserts_resume_and_reset(spark, tmp_path):
    source, store, cp = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "cp")
    assert S.read_run_state(spark, store).count() == 0

    def run():
        records = spark.readStream.schema(S.RUN_STATE + ", seq bigint").json(str(source))
        S.stream_upserts(records, store, cp)
        return {r.question_id: (r.parsed_code, r.error) for r in S.read_run_state(spark, store).collect()}

    write(source, "a.json", [rec("q1", 1, parsed_code="old"), rec("q1", 2, parsed_code="new"),
                             rec("q2", 1, request_failed=True, error="TimeoutError: x")])
    assert run() == {"q1": ("new", None), "q2": (None, "TimeoutError: x")}
    write(source, "b.json", [rec("q3", 1, error="code_parse_error")])
    assert set(run()) == {"q1", "q2", "q3"}

    S.reset_failed(spark, store)
    problems = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "question_id string")
    todo = pending(problems, S.read_run_state(spark, store), "question_id")
    assert sorted(r.question_id for r in todo.collect()) == ["q2", "q4"]

    write(source, "c.json", [rec("q2", 1, parsed_code="again")])
    assert run()["q2"] == ("again", None)


def test_new_stream_after_reset_loses_nothing(spark, tmp_path):
    store = str(tmp_path / "state")

    def run(name, rows):
        write(tmp_path / name, "r.json", rows)
        records = spark.readStream.schema(S.RUN_STATE + ", seq bigint").json(str(tmp_path / name))
        S.stream_upserts(records, store, str(tmp_path / f"cp-{name}"))
        return {r.question_id: r.parsed_code for r in S.read_run_state(spark, store).collect()}

    run("a", [rec("a", 1, request_failed=True, error="E: x"), rec("b", 1, parsed_code="b1")])
    S.reset_failed(spark, store)
    assert run("b", [rec("a", 1, parsed_code="a2")]) == {"a": "a2", "b": "b1"}
    # another stream in the same epoch
    assert run("c", [rec("b", 1, parsed_code="b3")]) == {"a": "a2", "b": "b3"}


def test_repeated_batch_is_idempotent(spark, tmp_path):
    store = str(tmp_path / "state")
    rows = spark.createDataFrame([("q1", 1, "E: x")], "question_id string, seq bigint, error string")
    S.upsert_state(rows, 0, store)
    S.upsert_state(rows, 0, store)
    assert S.read_run_state(spark, store, "question_id string, error string").count() == 1


def test_replace_table_keeps_the_old_version_until_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_table(spark, path, "x bigint").count() == 0
    assert replace_table(spark.range(3).withColumnRenamed("id", "x"), path) == 1
    old = read_table(spark, path, "x bigint")
    assert replace_table(spark.range(5).withColumnRenamed("id", "x"), path) == 2
    assert (old.count(), read_table(spark, path, "x bigint").count()) == (3, 5)
    # a version without its commit is invisible
    spark.range(9).write.parquet(f"{path}/data/broken")
    assert current_version(spark, path)[0] == 2
    remove_old(spark, path, keep=1, older_than=0)
    assert read_table(spark, path, "x bigint").count() == 5 and len(os.listdir(f"{path}/data")) == len(os.listdir(f"{path}/log")) == 1
    assert replace_table(spark.range(2).withColumnRenamed("id", "x"), path) == 3


def test_one_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(1), path)
    replace_table(spark.range(2), path, after=1)
    with pytest.raises(Conflict):
        replace_table(spark.range(3), path, after=1)
    assert read_table(spark, path, "id bigint").count() == 2 and read_table(spark, path, "id bigint", 1).count() == 1
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: put_if_absent(spark, f"{tmp_path}/c/log/7", str(k)), range(40)))
    assert sum(won) == 1 and (tmp_path / "c/log/7").read_text() == str(won.index(True)) and not os.listdir(tmp_path / "c/waiting")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: replace_table(spark.range(k), str(tmp_path / "many")), range(8)))
    assert sorted(versions) == list(range(1, 9))


def test_compaction_beside_batches(spark, tmp_path):
    store, schema = str(tmp_path / "state"), "question_id string, error string"

    def put(k, **errors):
        S.upsert_state(spark.createDataFrame([(q, 0, e) for q, e in errors.items()], "question_id string, seq int, error string"), k, store)

    def now():
        return {r.question_id: r.error for r in S.read_run_state(spark, store, schema).collect()}

    put(0, a="1", b="1")
    fold = S.fold_state(spark, store, schema, F.col("question_id") != "b")
    late = S.fold_state(spark, store, schema)
    put(1, a="2", c="2")
    S.commit_fold(spark, fold)
    assert now() == {"a": "2", "c": "2"}
    with pytest.raises(Conflict):
        S.commit_fold(spark, late)
    put(0, a="again")  # folded long ago
    put(2, b="3")
    S.compact_state(spark, store, schema)
    put(2, b="again")
    S.remove_folded(spark, store, 0)
    put(3, d="4")
    assert now() == {"a": "2", "b": "3", "c": "2", "d": "4"} and len(os.listdir(f"{store}/data")) == 2


def test_stream_over_rolled_files_equals_batch(spark, tmp_path):
    lines = acceptance_lines(Tables(spark, SMALL))
    lines.select("line").repartition(5).write.text(str(tmp_path / "logs"))
    streamed = spark.readStream.schema("line string").format("text").load(str(tmp_path / "logs"))
    run_available(streamed, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = read_table(spark, str(tmp_path / "out"), RESULT).first()
    want = acceptance_rate(acceptance_counts(lines.select("line"))).first()
    assert (round(got.rate, 9), got.n) == (round(want.rate, 9), want.n)
    # nothing new: the sums stay
    run_available(streamed, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert read_table(spark, str(tmp_path / "out"), RESULT).select(F.sum("n")).first()[0] == want.n
