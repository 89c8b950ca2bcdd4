"""Skew, partitioning and plan shape."""

import random

import pytest
from pyspark.sql import functions as F

from evalweave.operators import joins as J
from evalweave.operators import ordering as O
from evalweave.operators import quantiles as Q
from evalweave.plans import prompt_sets as P
from evalweave.queries import QUERIES
from tests.conftest import SMALL


def keyed(spark, n=400, spread=1, seed=1):
    """Two thirds of the rows in one group, keys over any distance."""
    r = random.Random(seed)
    keys = r.sample(range(-n * spread, n * spread), n)
    rows = [("hot" if i % 3 else f"g{i % 7}", k, r.randint(0, 9)) for i, k in enumerate(keys)]
    rows += [(None, k, 1) for k in range(3)]
    return rows, spark.createDataFrame(rows, "g string, k bigint, w bigint")


@pytest.mark.parametrize("spread", [1, 1 << 14, 1 << 30, 1 << 50])
def test_running_total_any_key_distance(spark, spread):
    rows, df = keyed(spark, spread=spread)
    got = {(r.g, r.k): (r.start, r.total) for r in
           O.running_total(df, "k", "g", F.col("w")).collect()}
    for g in {x[0] for x in rows}:
        total, run = sum(x[2] for x in rows if x[0] == g), 0
        for _, k, w in sorted(x for x in rows if x[0] == g):
            assert got[(g, k)] == (run, total)
            run += w


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_matter(spark, parts):
    _, df = keyed(spark)
    df = df.where("g is not null").repartition(parts)
    ranks = [r.rank for r in O.number_sorted(df.select("g", "k"), ["g", "k"]).orderBy("g", "k").collect()]
    assert ranks == list(range(1, 401))
    limited = O.limit_per_group(df, "g", "k", 0.5)
    assert limited.where("g = 'hot'").count() == (df.where("g = 'hot'").count() + 1) // 2
    text = df.select("k", F.repeat(F.lit("a b "), F.col("w").cast("int")).alias("t"))
    built = P.build_concat(text, "k", "t", 50)
    assert {r.n_tokens for r in built.collect()} == {50}
    assert sorted(r.sample for r in built.collect()) == list(range(built.count()))


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo = int(at)
    return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo)


def test_quantiles_are_exact(spark):
    r = random.Random(3)
    data = {"ties": [5.0] * 500 + [7.0], "signs": [r.uniform(-1, 1) * 10 ** r.randint(-8, 12) for _ in range(700)],
            "one": [3.25], "none": [None, None], "close": [1 + i * 1e-12 for i in range(300)]}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g string, x double")
    got = {r.g: r for r in Q.distribution(df, "x", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "g").collect()}
    assert (got["none"]["count"], got["none"].mean, got["none"].p50) == (0, None, None)
    for g in ("ties", "signs", "one", "close"):
        assert got[g]["count"] == len(data[g]) and got[g].max == max(data[g])
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert got[g][name] == pytest.approx(quantile(data[g], p), rel=1e-12)
    assert Q.distribution(df.where("g = 'x'"), "x", {"p50": 0.5}, "g").count() == 0


@pytest.mark.parametrize("n,samples", [(1, 10000), (3, 10), (10, 3), (7, 7)])
def test_cycle_assign(spark, n, samples):
    corpus = spark.range(n).select((F.col("id") * 5).alias("k"))
    got = {r.sample: r.k for r in J.cycle_assign(corpus, "k", samples).collect()}
    assert got == {i: (i % n) * 5 for i in range(samples)}


def test_short_corpus_repeats_to_the_length(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, "d")], "k bigint, t string")
    built = P.build_concat(df, "k", "t", 10, 3).orderBy("sample").collect()
    assert [r.question.split() for r in built] == [list("abcdabcdab")] * 3
    with_prefix = P.build_prefix(df, "k", "t", 12, 50, 2).collect()
    assert all(r.question.split()[:6] == list("abcdab") and r.n_tokens == 12 for r in with_prefix)
    with pytest.raises(ValueError):
        P.build_prefix(df, "k", "t", 1, 50)


def test_nothing_to_build(spark):
    empty = spark.createDataFrame([(0, " ")], "k bigint, t string")
    assert P.build_tiled(empty, "k", "t", 4, 3).count() == 0
    assert P.build_concat(empty, "k", "t", 4).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cartesian_products_and_no_row_functions(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan


@pytest.mark.parametrize("name,columns", [
    ("describe", "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>"),
    ("accuracy_scopes", "ReadSchema: struct<doc_id:bigint,lang:string,source:string>"),
    ("head_n", "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]"),
])
def test_scans_are_pruned(spark, name, columns):
    assert columns in plan_of(QUERIES[name](spark, SMALL))


def test_quantiles_without_a_group(spark):
    got = Q.distribution(spark.range(1001).select(F.col("id").cast("double").alias("x")), "x", {"p95": 0.95}).collect()
    assert [(r["count"], r.mean, r.p95) for r in got] == [(1001, 500.0, 950.0)]


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    from evalweave.operators import sizes

    small = spark.range(10)
    big = spark.range(100).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan_of(big.join(sizes.measured(small), big.k == F.col("id")))
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for side in (sizes.measured(small), sizes.bounded(small, 10)):
            joined = big.join(side, big.k == F.col("id"))
            assert "SortMergeJoin" in plan_of(joined) and joined.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- records that stay are joined last ----

@pytest.mark.parametrize("name", ["dedup_first", "dedup_last", "first_user_turn", "prompts_of"])
def test_no_texts_are_sorted_to_pick_records(spark, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, SMALL))


def test_ties_of_the_order_are_settled_by_the_record(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 5, "n"), (None, 5, "n"), ("b", None, "q"), ("c", 3, None)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "k string, o int, t string").repartition(parts)
        first = sorted(map(repr, map(tuple, O.dedup_first(df, "k", "o").collect())))
        assert len(first) == 4 and repr((None, 5, "n")) in first and repr(("b", None, "q")) in first
        assert first == sorted(map(repr, map(tuple, O.dedup_first(df.repartition(3), "k", "o").collect())))
        assert repr(("a", 2, "z")) in map(repr, map(tuple, O.dedup_last(df, "k", "o").collect()))
    two = spark.createDataFrame([(None, "x", 1), ("x", None, 2)], "a string, b string, o int")
    assert O.dedup_first(two, ["a", "b"], "o").count() == 2  # nulls tell keys apart


# ---- thresholds instead of numbers ----

@pytest.mark.parametrize("spread,limit", [(1, 5), (1, 0.34), (1 << 30, 150), (1 << 50, 0.34), (1 << 50, 10**6), (1 << 14, 0.0001)])
def test_limit_by_threshold(spark, spread, limit):
    rows, df = keyed(spark, spread=spread)
    want = []
    for g in {x[0] for x in rows}:
        keys = sorted(x[1] for x in rows if x[0] == g)
        want += [(g, k) for k in keys[:limit if isinstance(limit, int) else -int(-len(keys) * limit // 1)]]
    got = [(r.g, r.k) for r in O.limit_per_group(df, "g", "k", limit).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_limit_numbers_no_row(spark):
    """No window over the rows of a group, only over its few buckets."""
    _, df = keyed(spark)
    assert "Window" not in plan_of(O.limit_per_group(df, "g", "k", 0.5))
    assert O.limit_per_group(df.limit(0), "g", "k", 5).count() == 0
    texts = df.withColumn("t", F.lpad(F.col("k").cast("string"), 9, "0")).where("g is not null")
    assert O.limit_per_group(texts, "g", "t", 3).groupBy("g").count().where("count != 3").count() == 0


# ---- history of flat chats ----

def test_history_is_stored_once(spark):
    rows = [("c", t, "human" if t % 2 == 0 else "gpt", f"turn {t} é " + "x" * (t % 50)) for t in range(600)]
    rows += [("d", 0, "gpt", None), ("d", 1, "human", "hi"), ("d", 2, "human", "")]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    for mode in ("every", "every_with_gt"):
        segments = O.history_segments(turns, "human", mode, 100)
        kept = [r for r in rows if mode == "every_with_gt" or r[2] == "human"]
        size = sum(len(r[3] or "") + 1 for r in kept)
        assert sum(len(r.text) for r in segments.collect()) == size and max(len(r.text) for r in segments.collect()) == 100
        got = O.history_text(O.turn_requests(turns, "human", mode), segments, 100).collect()
        for r in got:
            assert r.history == "".join((x[3] or "") + "\n" for x in kept if x[0] == r.conv_id and x[1] < r.turn)
        assert len(got) == 302


# ---- sketches ----

def test_sketches_merge_within_their_bound(spark):
    r = random.Random(9)
    runs = {f"run{k}": [r.choice([r.gauss(k, 1), r.expovariate(0.1), 5.0]) for _ in range(1500 * (k + 1))] for k in range(4)}
    rows = [(g, x) for g, xs in runs.items() for x in xs] + [("none", None), ("run0", float("nan"))]
    stored = Q.sketch(spark.createDataFrame(rows, "run string, x double"), ["x"], "run")
    assert plan_of(stored).count("Scan") == 1  # one pass
    every = sorted(x for xs in runs.values() for x in xs)
    got = Q.described(Q.merge_sketches(stored)).first()
    assert got["count"] == len(every) and got["max"] == every[-1] and got["mean"] == pytest.approx(sum(every) / len(every))
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        below, upto = sum(x < got[name] for x in every), sum(x <= got[name] for x in every)
        assert below / len(every) - Q.RANK_ERROR <= p <= upto / len(every) + Q.RANK_ERROR
    single = {x.run: x for x in Q.described(stored, "run").collect()}
    assert single["none"]["count"] == 0 and single["none"].p50 is None and single["run3"]["count"] == 6000
