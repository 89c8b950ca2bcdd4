"""JSON arrays in runs, against the standard parser."""

import json
import random

import pytest

from evalweave.sinks import writers as WR
from evalweave.sources import files as S
from evalweave.sources import json_arrays as JA

SCHEMA = "id string, n bigint, t string, inner struct<a: array<struct<b: string>>>"


def awkward_text(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", "}}", '\\"', " "]) for _ in range(r.randint(0, 30)))


def objects(seed, n):
    r = random.Random(seed)
    return [{"id": str(k), "n": k, "t": awkward_text(r), "inner": {"a": [{"b": awkward_text(r)} for _ in range(r.randint(0, 4))]}}
            for k in range(n)]


def dumped(r, rows):
    return r.choice([json.dumps(rows), json.dumps(rows, indent=3, ensure_ascii=False), "﻿ \n" + json.dumps(rows, ensure_ascii=False) + "\n\n"])


def as_rows(df):
    return [(r.id, r.n, r.t, [x.b for x in r.inner.a]) for r in df.orderBy("ord").collect()]


def plain(rows):
    return [(x["id"], x["n"], x["t"], [y["b"] for y in x["inner"]["a"]]) for x in rows]


def test_runs_combine_to_the_whole():
    r = random.Random(2)
    for seed in range(300):
        text = json.dumps(objects(seed, 5), ensure_ascii=seed % 2 == 0).encode()
        parts = text.split(b"}")
        cuts = sorted(r.sample(range(1, len(parts)), min(4, len(parts) - 1)))
        runs = [b"}".join([*parts[a:b], b""]) for a, b in zip([0, *cuts], [*cuts, len(parts)])]
        inside, depth, found, held = False, 0, [], b""
        for run in runs:
            for piece, opens, closes in JA.records(run, inside, depth, 1):
                held = piece if opens else held + piece
                if closes:
                    found.append(json.loads(held))
            ends = [JA.transfer(run, False), JA.transfer(run, True)]
            inside, more = ends[inside]
            depth += more
        assert found == objects(seed, 5) and (inside, depth) == (False, -1)


@pytest.mark.parametrize("split,run", [(200, 50), (3000, 700), (1 << 27, 1 << 20)])
def test_arrays_of_many_files(spark, tmp_path, split, run):
    r, want = random.Random(split), []
    for k in range(5):
        rows = objects(10 * split + k, [0, 1, 40, 9, 60][k])
        (tmp_path / f"f{k}.json").write_text(dumped(r, rows), encoding="utf-8")
        want += plain(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        df = JA.read_json_arrays(spark, str(tmp_path), SCHEMA, run)
        assert as_rows(df) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_record_longer_than_many_runs(spark, tmp_path):
    rows = [{"id": "a", "n": 1, "t": "}" * 5000, "inner": {"a": [{"b": '"}{' * 900}]}}, {"id": "b", "n": 2, "t": "", "inner": {"a": []}}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert as_rows(JA.read_json_arrays(spark, str(tmp_path), SCHEMA, 100)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_objects_without_an_array(spark, tmp_path):
    rows = objects(4, 12)
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, rows)))
    assert as_rows(JA.read_json_arrays(spark, str(tmp_path), SCHEMA, 64)) == plain(rows)


def test_an_array_that_does_not_end(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(objects(4, 12))[:-20])
    with pytest.raises(ValueError, match="does not end"):
        JA.read_json_arrays(spark, str(tmp_path), SCHEMA, 64)


def test_one_file_is_read_by_many_tasks_and_once(spark, tmp_path):
    """The array equals what the reader of whole files gives; each byte range is a task."""
    chats = [{"id": str(k), "conversations": [{"from": "human", "value": f"text {k} " * 40}, {"from": "gpt", "value": "}"}]} for k in range(4000)]
    path = tmp_path / "big.json"
    path.write_text(json.dumps(chats))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    tracker = spark.sparkContext.statusTracker()
    try:
        spark.sparkContext.setJobGroup("arrays", "arrays")
        df = S.read_nested_chats(spark, str(path))
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("arrays") for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) >= path.stat().st_size // (1 << 16)
        path.rename(tmp_path / "gone.json")  # what comes later reads the kept runs
        got = {(r.id, r.conversations[0].value) for r in df.collect()}
    finally:
        spark.sparkContext.setJobGroup("", "")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.read.schema(S.CHATS).json(str(tmp_path / "gone.json"), multiLine=True)
    assert got == {(r.id, r.conversations[0].value) for r in whole.collect()} and len(got) == 4000


def test_written_arrays_are_json(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "'a\"}' AS t").repartition(3)
    WR.write_json_arrays(df, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert sorted(x["id"] for f in files for x in json.loads(f.read_text())) == list(range(10))
