"""Writers for prompt sets, question files, summaries and results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave import constants as C


GROUP_FILES, GROUP_RECORDS = 4, 1_000_000


def prompt_rows(prompts: DataFrame, column: str) -> DataFrame:
    return prompts.select(F.col(column).alias("question"), F.lit(C.NO_ANSWER).alias("answer"))


def write_prompt_set(prompts: DataFrame, column: str, path: str) -> None:
    """JSON lines (question, answer); an existing set is left alone."""
    prompt_rows(prompts, column).write.mode("ignore").json(path)


def vqa_rows(samples: DataFrame, image: str, start: int = C.FIRST_QUESTION_ID) -> DataFrame:
    """Visual questions for numbered samples (sample, question)."""
    return samples.select(
        F.lit(image).alias("image"), "question",
        (F.col("sample") + start).alias("question_id"), F.lit("None").alias("answer"))


def annotation_rows(samples: DataFrame, start: int = C.FIRST_QUESTION_ID) -> DataFrame:
    a = C.ANNOTATION
    answer = F.struct(
        F.lit(a["answer_id"]).cast("bigint").alias("answer_id"), F.lit(a["answer"]).alias("answer"),
        F.lit(a["answer_confidence"]).alias("answer_confidence"))
    return samples.select(
        F.lit(a["image_id"]).cast("bigint").alias("image_id"), F.lit(a["answer_type"]).alias("answer_type"),
        F.lit(a["question_type"]).alias("question_type"),
        (F.col("sample") + start).alias("question_id"), F.array(answer).alias("answers"))


def choice_rows(samples: DataFrame, video: str) -> tuple[DataFrame, DataFrame]:
    """Choice questions and their answer table, both by index."""
    choices = F.create_map(*[F.lit(x) for kv in C.CHOICES.items() for x in kv])
    questions = samples.select(
        F.col("sample").alias("idx"), F.lit(video).alias("vid_path"), F.lit("1").alias("video_id"),
        "question", choices.alias("choices"))
    answers = samples.select(F.col("sample").alias("idx"), F.lit(C.CHOICE_ANSWER).alias("answer"))
    return questions, answers


def fixed_decimals(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def subset_summary(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("name").alias("subset"), "num", fixed_decimals(F.col("score")).alias("acc"))


def write_summary(rows: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """The same rows as CSV with a header and as JSON, null as an empty cell."""
    rows = rows.select(*fields) if fields else rows
    rows.write.mode("overwrite").csv(f"{path}/csv", header=True)
    rows.write.mode("overwrite").json(f"{path}/json")


def write_packed(texts: DataFrame, file_path: Column, text: str, path: str) -> None:
    """Texts that would be a small file each, as lines of few files, with the path that each
    would have had. The readers take them with ``packed``."""
    texts.select(F.col(text).alias("value"), file_path.alias("file_path")).write.mode("overwrite").json(path)


def write_result_groups(cases: DataFrame, details: DataFrame, path: str) -> None:
    """Case summaries and details by (dataset_type, input_len, pfx).

    A failed case keeps its row, with null metrics. Files follow the groups, so a
    reader of one group prunes the others. A group is dealt to at most ``GROUP_FILES``
    tasks, which bounds both the number of small files and what one task writes of a
    large group.
    """
    keys = ["dataset_type", "input_len", "pfx"]
    for name, df in (("summary", cases), ("detail", details)):
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(GROUP_FILES))
        df.repartition(*keys, salt).write.option("maxRecordsPerFile", GROUP_RECORDS).mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}")


def write_chat_subset(chats: DataFrame, path: str, array: bool = False) -> None:
    """Nested chats as JSON lines, or each file as one array; each chat is a row already,
    nothing is grouped. The readers' ``ord`` is left out."""
    chats = chats.drop("ord")
    if array:
        write_json_arrays(chats, path)
    else:
        chats.write.mode("overwrite").json(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = "["
    for batch in batches:
        lines = []
        for row in batch.column(0).to_pylist():
            lines += [mark, row]
            mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]"] if mark == "," else ["[]"])], ["value"])


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """One file a partition, each a JSON array of its rows."""
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def prediction_rows(attached: DataFrame, key: str) -> DataFrame:
    return attached.select(key, F.array("parsed_code").alias("code_list"))


def write_predictions(attached: DataFrame, key: str, path: str) -> None:
    prediction_rows(attached, key).write.mode("overwrite").json(f"{path}/predictions")
    attached.write.mode("overwrite").json(f"{path}/raw")
