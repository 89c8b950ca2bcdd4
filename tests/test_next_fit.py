"""Next-fit packing against a cursor that walks the texts."""

import random

import pytest
from pyspark.sql import functions as F

from evalweave.operators import joins as J
from evalweave.plans import next_fit as NF
from evalweave.plans import prompt_sets as P


def walk(sizes, budget, n_samples=None):
    """[(sample, text, offset, size)] of one text after the other."""
    out, cursor, sample = [], 0, 0
    while sample < n_samples if n_samples is not None else cursor < len(sizes):
        got = 0
        while got < budget and (n_samples is not None or cursor < len(sizes)):
            size = sizes[cursor % len(sizes)]
            out.append((sample, cursor % len(sizes), got, size))
            got += size
            cursor += 1
        sample += 1
    return sorted(out)


def offsets(spark, sizes, parts=3):
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows.append((k, n, at, sum(sizes)))
        at += n
    return spark.createDataFrame(rows, "k bigint, n_tokens bigint, start bigint, total bigint").repartition(parts)


def sizes_of(seed):
    r = random.Random(seed)
    kind = [lambda: 1, lambda: r.randint(1, 9), lambda: r.choice([1, 1, 1, 400]), lambda: r.randint(90_000, 300_000)][seed % 4]
    return [kind() for _ in range(r.randint(1, 120))]


@pytest.mark.parametrize("seed", range(4))
def test_next_fit_is_that_of_a_cursor(spark, seed):
    sizes = sizes_of(seed)
    budget = [1, 7, 30, 150_000][seed]
    df = offsets(spark, sizes)
    assert sorted(map(tuple, NF.pack_next_fit(df, "k", budget).collect())) == walk(sizes, budget)
    n = 3 + len(sizes) // 2
    assert sorted(map(tuple, NF.pack_next_fit(df, "k", budget, n).collect())) == walk(sizes, budget, n)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitions_do_not_matter(spark, parts):
    sizes = sizes_of(1)
    got = NF.pack_next_fit(offsets(spark, sizes, parts), "k", 11).collect()
    assert sorted(map(tuple, got)) == walk(sizes, 11)


def test_a_small_corpus_and_many_samples(spark, monkeypatch):
    monkeypatch.setattr(J, "SLICE", 100)
    sizes = [3, 5, 2]
    got = NF.pack_next_fit(offsets(spark, sizes), "k", 23, 2000)  # a sample goes around twice
    assert sorted(map(tuple, got.collect())) == walk(sizes, 23, 2000)


def test_next_fit_of_nothing(spark):
    none = offsets(spark, [1]).limit(0)
    assert NF.pack_next_fit(none, "k", 5).count() == NF.pack_next_fit(offsets(spark, [1, 2]), "k", 5, 0).count() == 0
    with pytest.raises(ValueError, match="0 tokens"):
        NF.pack_next_fit(none, "k", 0)


def test_built_samples_have_the_length(spark):
    texts = spark.createDataFrame([(k, "w " * (1 + k % 13)) for k in range(200)] + [(900, " "), (901, None)], "k bigint, t string")
    built = NF.build_next_fit(texts, "k", "t", 40, 70).collect()
    assert sorted(r.sample for r in built) == list(range(70)) and {r.n_tokens for r in built} == {40}
    assert {len(r.question.split()) for r in built} == {40}


def test_levels_shrink(spark):
    """Chains fall together, so that all levels together are a few times the texts."""
    r = random.Random(5)
    sizes = [r.randint(1, 60) for _ in range(4000)]
    links = NF.successors(offsets(spark, sizes), 300)
    level, seen = links.where("laps = 0"), []
    for _ in range(6):
        seen.append(level.count())
        reached = level.select(F.col("next").alias("__r")).distinct()
        level = NF._joined(level.join(reached, F.col("node") == F.col("__r"), "left_semi"), level)
    assert sum(seen) < 3 * len(sizes) and seen[-1] < len(sizes) / 6


def test_no_task_holds_a_few_texts_that_make_all_samples(spark, monkeypatch):
    """Ten texts and many samples: build_tiled cuts each text's samples into slices."""
    monkeypatch.setattr(J, "SLICE", 500)
    monkeypatch.setattr(J, "CYCLE_BLOCK", 64)
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(10)], "k bigint, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        built = P.build_tiled(texts, "k", "t", 4, 20_000)
        sizes = [r["count"] for r in built.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
        rows = built.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.sample, r.k) for r in rows} == {(i, i % 10) for i in range(20_000)}


def test_levels_do_not_go_through_the_driver(spark, monkeypatch):
    """Joins of levels are shuffled; only a bounded number of samples is broadcast."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df)
    materialize = NF.materialize
    monkeypatch.setattr(NF, "materialize", kept)
    monkeypatch.setattr(NF, "FEW", 2)
    sizes = [3, 5, 2, 7] * 10
    got = NF.pack_next_fit(offsets(spark, sizes), "k", 6, 25)
    assert sorted(map(tuple, got.collect())) == walk(sizes, 6, 25)
    assert sum("BroadcastHashJoin" in p for p in plans) <= 2
    assert any("SortMergeJoin" in p for p in plans)
