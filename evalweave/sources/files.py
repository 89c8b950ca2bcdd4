"""Readers for corpora, problem banks, metric files and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave import constants as C
from evalweave.functions.cases import case_from_object, parse_cases
from evalweave.functions.messages import decode_chunk, score_value
from evalweave.functions.text import join_name_path, nonblank
from evalweave.operators.filters import filter_nonblank, filter_role
from evalweave.operators.ordering import first_user_turn
from evalweave.sources.json_arrays import read_json_arrays

CHATS = "id string, conversations array<struct<from: string, value: string>>"
PROBLEM = "question_id string, question_title string, platform string, difficulty string, contest_date timestamp"
PROBLEM_REQUIRED = ["question_id", "question_title", "platform", "difficulty", "contest_date"]


def _run_dir(path: str = "_metadata.file_path") -> Column:
    return F.regexp_replace(F.col(path), r"/[^/]*$", "")


def _stem(path: str = "_metadata.file_path") -> Column:
    return F.regexp_replace(F.col(path), r"\.[^./]*$", "")


def whole_texts(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(value, columns of the folders' names, file_path): each file as one text. A file costs
    its listing and its opening, however short it is, so ``packed`` files hold many texts,
    as ``writers.write_packed`` leaves them."""
    if packed:
        return spark.read.schema("value string, file_path string").json(path)
    return spark.read.text(path, wholetext=True).select("*", "_metadata.file_path")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Add ``ord``: file, block and line, a unique key that sorts as the rows lie in their
    files. It costs no shuffle; what needs a dense number makes one of it."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                     F.monotonically_increasing_id().alias("line"))
    return rows.select(place.alias("ord"), "*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, question)."""
    return in_file_order(spark.read.schema("question string").json(path))


def read_nested_chats(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(ord, id, conversations): one row per chat of JSON array files, or of JSON lines.
    Both are shared by tasks, whatever the size of a file."""
    if multi_line:
        return read_json_arrays(spark, path, CHATS)
    return in_file_order(spark.read.schema(CHATS).json(path))


def chat_turns(chats: DataFrame) -> DataFrame:
    """Nested chats -> (conv_id, turn, role, text)."""
    at = F.posexplode("conversations").alias("turn", "t")
    return chats.select(F.col("id").alias("conv_id"), at).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.col("t.from").alias("role"), F.col("t.value").alias("text"))


def corpus_turns(turns: DataFrame, role: str = "human", human: str = C.HUMAN) -> DataFrame:
    """Turns of the wanted role that hold text."""
    return filter_nonblank(filter_role(turns, role, human), "text")


def read_chats(spark: SparkSession, path: str, role: str = "human", multi_line: bool = True) -> DataFrame:
    turns = corpus_turns(chat_turns(read_nested_chats(spark, path, multi_line)), role)
    if turns.isEmpty():
        raise ValueError(f"no {role} turn with text in {path}")
    return turns


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text): ``problem_statement`` if there is one, else the first column, of every file."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    name = "problem_statement" if "problem_statement" in df.columns else df.columns[0]
    texts = in_file_order(df).select("ord", F.col(name).cast("string").alias("text"))
    texts = filter_nonblank(texts, "text")
    if texts.isEmpty():
        raise ValueError(f"no text in column {name} of {path}")
    return texts


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problem bank lines with ``malformed`` and ``src_ord``, their place in the
    source. Blank lines are no rows; lines that do not parse or lack a field are
    kept and marked, for the counters."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    order = F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = lines.select("value", order.alias("src_ord")).where(nonblank("value"))
    parsed = F.from_json("value", PROBLEM + ", _bad string",
                         {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.select(parsed.alias("p"), "src_ord").select("p.*", "src_ord")
    missing = F.greatest(*[F.col(c).isNull() for c in PROBLEM_REQUIRED])
    return rows.withColumn("malformed", F.col("_bad").isNotNull() | missing).drop("_bad")


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """Metric tables with a header; the position in the file is kept as ``ord``."""
    schema = ", ".join(f"{c} string" for c in C.METRIC_COLUMNS)
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
    return df.select("*", _run_dir().alias("run_dir"), _stem().alias("stem"),
                     F.monotonically_increasing_id().alias("ord")).where(nonblank("param"))


def common_entries(text: str) -> Column:
    """{metric: {stage: value}} -> array of (metric, stage, value), every stage; a metric
    without one has null for both."""
    metrics = F.from_json(F.col(text), "map<string,map<string,string>>")

    def entries(e: Column) -> Column:
        none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
        stages = F.map_entries(e["value"])
        stages = F.when(F.coalesce(F.size(stages), F.lit(0)) > 0, stages).otherwise(none)
        return F.transform(stages, lambda s: F.struct(e["key"].alias("metric"), s["key"].alias("stage"), s["value"].alias("value")))

    return F.flatten(F.transform(F.map_entries(metrics), entries))


def read_common_metrics(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Metrics of each file, or of each text of ``packed`` files, with their directory and stem."""
    texts = whole_texts(spark, path, packed)
    files = texts.select("value", _run_dir("file_path").alias("run_dir"), _stem("file_path").alias("stem"))
    return files.select("run_dir", "stem", F.explode(common_entries("value")).alias("e")).select(
        "run_dir", "stem", "e.*")


def read_run_summaries(spark: SparkSession, path: str, name: str = "benchmark_summary.json") -> DataFrame:
    """Many run summaries, one wide row each, with their directory."""
    schema = T.StructType([T.StructField(k, T.DoubleType()) for k in C.RUN_SUMMARY_KEYS])
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", name).json(path, multiLine=True)
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in C.RUN_SUMMARY_KEYS.items()],
                     _run_dir().alias("run_dir"))


def read_percentiles(spark: SparkSession, path: str, name: str = "benchmark_percentile.json") -> DataFrame:
    """Percentile rows per run; missing or broken files give no rows."""
    fields = ["Percentiles string", *[f"`{k}` double" for k in C.PERCENTILE_KEYS]]
    df = spark.read.schema(", ".join(fields)).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", name).option("ignoreCorruptFiles", "true").json(path, multiLine=True)
    return df.where("Percentiles is not null").select(
        F.col("Percentiles").alias("percentile"),
        *[F.col(f"`{k}`").alias(v) for k, v in C.PERCENTILE_KEYS.items()], _run_dir().alias("run_dir"))


REPORT = (
    "score string, metrics array<struct<score: string, macro_score: string, num: bigint,"
    " categories: array<struct<name: string, num: bigint, score: string,"
    " subsets: array<struct<name: string, num: bigint, score: string>>>>>>"
)


def report_scores(reports: DataFrame, text: str) -> DataFrame:
    """Totals and subset rows of evaluation reports given as JSON text.

    Scores may be numbers or objects; a report without any subset falls back to
    its categories. All of it is row-local.
    """
    rows = reports.withColumn("__r", F.from_json(text, REPORT)).withColumn("__m", F.get("__r.metrics", F.lit(0)))
    cats = F.coalesce(F.col("__m.categories"), F.array())

    def scored(x: Column, name: Column) -> Column:
        return F.struct(name.alias("name"), F.coalesce(x["num"], F.lit(0)).alias("num"),
                        score_value(x["score"]).alias("score"))

    def category_name(c: Column) -> Column:
        parts = F.from_json(c["name"], "array<string>")
        is_list = F.startswith(F.ltrim(c["name"]), F.lit("["))
        return F.coalesce(F.when(is_list, join_name_path(parts)).otherwise(c["name"]), F.lit(""))

    subsets = F.flatten(F.transform(cats, lambda c: F.transform(
        F.coalesce(c["subsets"], F.array()), lambda s: scored(s, F.coalesce(s["name"], F.lit(""))))))
    rows = rows.withColumn("__s", subsets).withColumn("subsets", F.when(
        F.size("__s") > 0, F.col("__s")).otherwise(F.transform(cats, lambda c: scored(c, category_name(c)))))
    total = score_value(F.coalesce("__m.score", "__r.score"))
    counted = F.aggregate("subsets", F.lit(0).cast("bigint"), lambda a, s: a + s["num"])
    return rows.withColumn("score", total).withColumn(
        "macro_score", F.when(F.col("__m.macro_score").isNull(), F.col("score")).otherwise(
            score_value(F.col("__m.macro_score")))
    ).withColumn("num", F.coalesce(F.nullif(F.col("__m.num"), F.lit(0)), F.when(
        F.col("__m").isNotNull(), counted).otherwise(0))).drop("__r", "__m", "__s")


def read_eval_reports(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("report"))
    return report_scores(files, "value").drop("value")


def subset_rows(reports: DataFrame, key: str = "report") -> DataFrame:
    return reports.select(key, F.explode("subsets").alias("s")).select(key, "s.*")


def _prompt_kind(spark: SparkSession, path: str) -> str:
    """What a prompt file or folder holds, by how its first text begins."""
    first = spark.read.option("lineSep", "}").text(path).where(nonblank("value")).first()
    if first is None:
        return "prompts"
    if first.value.lstrip("\ufeff \t\r\n").startswith("["):
        return "chat arrays"
    return "chat lines" if re.search(r'(?<!\\)"conversations"\s*:', first.value) else "prompts"


def read_prompts(spark: SparkSession, path: str, n: int = 0, kind: str | None = None) -> DataFrame:
    """(ord, prompt) of JSON lines (question, else prompt) or of chats, as an array or as lines
    (the first human turn of each); the first ``n`` in file order, 0 for all.

    ``kind`` is "prompts", "chat arrays" or "chat lines"; without it the content decides, for
    files and for folders. Chats of which none has conversations are an error.
    """
    kind = _prompt_kind(spark, path) if kind is None else kind
    if kind == "prompts":
        rows = in_file_order(spark.read.schema("question string, prompt string").json(path))
        rows = rows.select("ord", F.coalesce(
            F.nullif("question", F.lit("")), F.nullif("prompt", F.lit(""))).alias("prompt")
        ).where("prompt is not null")
    elif kind in ("chat arrays", "chat lines"):
        chats = read_nested_chats(spark, path, kind == "chat arrays")
        if chats.where("conversations is not null").isEmpty():
            raise ValueError(f"no conversations in {path}")
        first = F.get(F.filter("conversations", lambda t: t["from"] == C.HUMAN), F.lit(0))
        rows = chats.select("ord", first["value"].alias("prompt")).where("prompt <> ''")
    else:
        raise ValueError(f"unknown kind of prompts: {kind!r}")
    return rows.orderBy("ord").limit(n) if n > 0 else rows


def prompts_of(turns: DataFrame, human: str) -> DataFrame:
    """Flat chats -> one prompt per chat."""
    return first_user_turn(turns, human).select("conv_id", F.col("text").alias("prompt"))


def case_rows(files: DataFrame, text: str) -> DataFrame:
    """Cases from JSON text: a map or list of texts or objects. Bad ones keep a
    reason; the other columns of ``files`` stay."""
    others = [c for c in files.columns if c != text]
    entries = F.transform(
        F.map_entries(F.from_json(text, "map<string,variant>")),
        lambda e: F.struct(e["key"].alias("seq"), e["value"].alias("raw")))
    items = F.transform(F.from_json(text, "array<variant>"), lambda v, i: F.struct(
        (i + 1).cast("string").alias("seq"), v.alias("raw")))
    is_list = F.startswith(F.ltrim(text), F.lit("["))
    rows = files.select(*others, F.explode(F.when(is_list, items).otherwise(entries)).alias("e"))
    rows = rows.select(*others, "e.*")
    rows = parse_cases(rows.withColumn("__text", F.col("raw").cast("string")), "__text")
    kind = F.schema_of_variant("raw")
    as_object = case_from_object("raw", "seq")
    fields = ["dataset_type", "input_len", "out_len", "concurrency", "request_rate", "pfx", "reject_reason"]
    text_case = F.struct(F.col("seq").alias("seq"), *[F.col(f"case.{f}").alias(f) for f in fields])
    bad = F.struct(
        F.col("seq").alias("seq"), *[F.lit(None).cast(t).alias(f) for f, t in zip(
            fields, ["string", "bigint", "bigint", "bigint", "double", "bigint"])],
        F.lit("neither text nor object").alias("reject_reason"))
    case = F.when(kind.startswith("OBJECT"), as_object).when(kind == "STRING", text_case).otherwise(bad)
    return rows.select(*others, case.alias("c")).select(*others, "c.*")


def read_cases(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Cases of each file, or of each text of ``packed`` files, which keep its ``file_path``."""
    texts = whole_texts(spark, path, packed)
    return case_rows(texts if packed else texts.drop("file_path"), "value")


def decoded_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("__d", decode_chunk("line")).select(*chunks.columns, "__d.*").drop("line")


def read_chunk_log(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses (request_id, seq, ts, line) as JSON lines, decoded."""
    return decoded_chunks(spark.read.schema(
        "request_id string, seq bigint, ts timestamp_ntz, line string").json(path))
