"""Prompt files and folders, told apart by what they hold."""

import json

import pytest

from evalweave.sinks import writers as WR
from evalweave.sources import files as S

CHATS = [{"id": "a", "conversations": [{"from": "gpt", "value": "x"}, {"from": "human", "value": "one"}]},
         {"id": "b", "conversations": [{"from": "human", "value": "two \"conversations\": ["}]}]


def test_a_written_folder_is_read_back(spark, tmp_path):
    df = spark.range(7).selectExpr("concat('prompt ', id) AS q")
    WR.write_prompt_set(df.repartition(3), "q", str(tmp_path / "set"))
    assert sorted(r.prompt for r in S.read_prompts(spark, str(tmp_path / "set")).collect()) == [f"prompt {k}" for k in range(7)]


@pytest.mark.parametrize("name,text", [
    ("a.json", json.dumps(CHATS)), ("b.jsonl", "\n".join(map(json.dumps, CHATS))), ("c.txt", "\n  " + json.dumps(CHATS, indent=2))])
def test_chats_of_any_name(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    got = S.read_prompts(spark, str(tmp_path / name)).orderBy("ord").collect()
    assert [r.prompt for r in got] == ["one", 'two "conversations": [']
    assert [r.prompt for r in S.read_prompts(spark, str(tmp_path / name), 1).collect()] == ["one"]


def test_what_is_no_prompt_file_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"other": 1}]')
    with pytest.raises(ValueError, match="no conversations"):
        S.read_prompts(spark, str(tmp_path / "a.json"))
    with pytest.raises(ValueError, match="unknown kind"):
        S.read_prompts(spark, str(tmp_path / "a.json"), kind="tables")
    (tmp_path / "q.jsonl").write_text('{"question": "says \\"conversations\\": [1]"}\n{"prompt": "p"}\n')
    assert S.read_prompts(spark, str(tmp_path / "q.jsonl")).count() == 2
