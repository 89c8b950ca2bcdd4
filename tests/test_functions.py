"""Scalar functions against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.functions import cases as K
from evalweave.functions import metrics as M
from evalweave.functions import text as T
from evalweave.operators import filters as FL
from evalweave.operators import ordering as O
from evalweave.operators import sets as S
from evalweave.plans.matrix import workload_matrix

RATES = [None, 0.0, 2.5, 1.0, 100000.0, 0.1, 0.5, 1 / 3, 2 / 3, 12345.678, 123456.7, 999999.5, 1234567.5, 1e-5, 0.00012345678,
         0.000999999, 9.9999995, 98.76543219, -2.5, 1e-7, 3.0e10 + 0.5, 0.001, 0.0123456789,
         0.00009999999, 0.0000999999, 999999.4]


def one(spark, rows, kind, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column.alias("y")).orderBy("i").select("y").collect()]


def python_rate(x):
    if x is None:
        return "na"
    return str(int(x)) if x == int(x) else f"{x:g}"


def test_format_rate(spark):
    assert one(spark, RATES, "double", T.format_rate("x")) == [python_rate(x) for x in RATES]


def test_numbers_in_text(spark):
    texts = ["25282.1 ms", "40.5053 token/s", "4", "n/a", None, "a-7b", "12.", ""]
    assert one(spark, texts, "string", T.parse_number("x")) == [25282.1, 40.5053, 4.0, None, None, -7.0, 12.0, None]


def test_names_and_text(spark):
    assert one(spark, ["a[b]:c*d?e/f\\g" + "x" * 40], "string", T.safe_name("x")) == [("a_b__c_d_e_f_g" + "x" * 40)[:31]]
    assert one(spark, ["\x1b[1mok\t\n\r\x00"], "string", T.clean_text("x")) == ["[1mok\t\n\r"]
    assert one(spark, ["a</think>b</think> c", "none"], "string", T.remove_until("x")) == [" c", "none"]
    assert one(spark, ["E: a: b", "plain"], "string", T.error_category("x")) == ["E", "plain"]
    replies = ["x\n```py\na\n```\ny\n```\nb\nc\n```", "no block"]
    assert one(spark, replies, "string", T.extract_code("x")) == ["b\nc\n", ""]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n\t", max_size=25), min_size=1, max_size=30), st.integers(1, 9))
def test_tokens_cut_and_tile(spark, texts, length):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    rows = df.select("i", T.token_count("x").alias("n"), T.truncate_tokens("x", length).alias("cut"),
                     T.tile_tokens("x", length).alias("tiled"), T.approx_tokens("x").alias("a")).collect()
    for r in rows:
        words = texts[r.i].split()
        tiled = (words * (length // len(words) + 1))[:length] if words else None
        assert r.n == len(words) and r.cut == " ".join(words[:length])
        assert r.tiled == (None if tiled is None else " ".join(tiled))
        assert r.a == max(len(texts[r.i]) // 4, 1)


def test_retries(spark):
    waits = [[min(2 * 2 ** (a - 1), 30) for a in range(1, k)] for k in range(1, 9)]
    got = one(spark, list(range(1, 9)), "int", M.total_retry_wait("x", 2.0, 30.0))
    assert got == [float(sum(w)) for w in waits]
    assert one(spark, [1, 4, 9], "int", M.retry_delay("x", 2.0, 30.0)) == [2.0, 16.0, 30.0]
    assert one(spark, [1, 3], "int", M.total_retry_wait("x", 8.0, 4.0)) == [0.0, 8.0]


def test_counts_and_shares(spark):
    assert one(spark, [1, 8], "bigint", M.auto_sample_count("x")) == [20, 80]
    assert one(spark, [1, 8], "bigint", M.auto_sample_count("x", 5)) == [5, 5]
    assert one(spark, [3], "bigint", M.sample_count("x", 0)) == [3]
    assert one(spark, [100, 1, 2], "bigint", M.prefix_length("x", F.lit(85))) == [85, None, 1]
    pairs = spark.sql("select array(1, 8) c, array(20, 30) n, array(5) short")
    row = pairs.select(M.paired_sample_counts("c", "n").alias("p"), M.paired_sample_counts("c", "short").alias("q")).first()
    assert ([tuple(x) for x in row.p], row.q) == ([(1, 20), (8, 30)], None)
    assert one(spark, [7, 0], "bigint", M.warmup_total("x", F.lit(2), F.lit(0), F.lit(16))) == [7, 32]


def test_case_text(spark):
    texts = ["GSM:1-2-3-4", " 5-6-7-0.5-90 ", "5-6-7-0.5-0", "x-1-1-1", "1-2-3", None, "1-2-3-4-", "other:1-2-3-4"]
    df = K.parse_cases(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string"), "x")
    got = [tuple(r.case) for r in df.orderBy("i").collect()]
    assert got[0] == ("gsm", 1, 2, 3, 4.0, None, None)
    assert got[1] == ("sharegpt", 5, 6, 7, 0.5, 90, None)
    assert got[2][5:] == (None, None)
    assert [g[-1] for g in got[3:]] == ["bad number", "too few fields", "too few fields", "bad prefix share", "bad number"]


def test_artifact_names(spark):
    rows = [(None,), (0,), (85,)]
    df = spark.createDataFrame(rows, "p int").withColumn(
        "a", K.artifact_name(F.lit("GSM8K-in"), F.lit(64), F.lit(10), F.col("p")))
    names = [r[0] for r in df.select(K.case_name("a", F.lit(1))).collect()]
    assert names == ["GSM8K-in64-bs10-1并发", "GSM8K-in64-bs10-1并发", "GSM8K-in64-bs10-pfx85-1并发"]


def test_lists_and_validation(spark):
    df = spark.createDataFrame([("lcb, agent,lcb  x",), ("",)], "m string")
    words, unknown = S.ordered_distinct("m", F.array(F.lit("lcb"), F.lit("agent")))
    assert [tuple(r) for r in df.select(words, unknown).collect()] == [(["lcb", "agent", "x"], ["x"]), ([], [])]
    rows = spark.createDataFrame([("1", 5, 9), ("x", 9, 5), ("-1", None, 5)], "n string, lo int, hi int")
    good, bad = FL.split_valid(FL.validate_rows(
        rows, {"n": FL.whole_number("n"), "lo <= hi": F.col("lo") <= F.col("hi")}))
    assert good.count() == 1 and sorted(r.violations for r in bad.collect()) == [["n", "lo <= hi"], ["n", "lo <= hi"]]


def test_limits(spark):
    df = spark.range(10).withColumn("g", F.lit("a"))
    assert FL.head_n(df, ["id"], 0).count() == 10 and FL.head_n(df, ["id"], 3).count() == 3
    assert [r.id for r in FL.first_n_positions(df, "id", 4).orderBy("id").collect()] == [0, 1, 2, 3]
    assert O.limit_per_group(df, "g", "id", 0).count() == 10
    assert O.limit_per_group(df, "g", "id", 1.0).count() == 10
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            O.limit_per_group(df, "g", "id", bad)


def test_matrix_order(spark):
    types = spark.createDataFrame([(9, "b"), (4, "a")], "ord bigint, dataset_type string")
    rows = workload_matrix(types, [1, 2], [3], [None, 0, 85]).orderBy("seq").collect()
    assert [(r.dataset_type, r.input_len, r.pfx) for r in rows[:4]] == [("a", 1, None), ("a", 1, None), ("a", 1, 85), ("a", 2, None)]
    assert [r.seq for r in rows] == list(range(1, 13))
