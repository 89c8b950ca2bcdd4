"""Samples on demand: what is read follows the samples, not the corpus."""

import re

import pytest
from pyspark.sql import functions as F

from evalweave.plans import prompt_sets as P
from tests.test_scale import plan_of


def stored(spark, path, n, files=20, words=30):
    """A corpus whose files follow the key."""
    df = spark.range(n).select((7 + 3 * F.col("id")).alias("k"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), words).alias("t"))
    df.repartitionByRange(files, "k").sortWithinPartitions("k").write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n_samples", [40, 2000])
def test_head_gives_the_same_samples(spark, tmp_path, monkeypatch, n_samples):
    corpus = stored(spark, tmp_path / "c", 1000)
    built = [rows(P.build_concat(corpus, "k", "t", 50, n_samples)), rows(P.build_prefix(corpus, "k", "t", 50, 40, n_samples))]
    monkeypatch.setattr(P, "key_range", lambda corpus, key: None)
    assert built == [rows(P.build_concat(corpus, "k", "t", 50, n_samples)), rows(P.build_prefix(corpus, "k", "t", 50, 40, n_samples))]
    assert len(built[0]) == len(built[1]) == n_samples


def test_work_follows_the_samples(spark, tmp_path):
    read = []
    for n in (2000, 16000):
        corpus = stored(spark, tmp_path / f"c{n}", n)
        head, offsets = P.corpus_head(corpus, "k", "t", 50 * 82, lambda o: P._full_buckets(o, 50, 80))
        read.append(offsets.count())
        assert len(head.where("k is not null").select("k").distinct().collect()) == read[-1]
    assert read[0] >= 80 * 50 // 30 and read[1] < 2 * read[0] < 1500


def test_key_filter_reaches_the_scan(spark, tmp_path):
    corpus = stored(spark, tmp_path / "c", 4000)
    for built in (P.build_concat(corpus, "k", "t", 50, 80), P.build_prefix(corpus, "k", "t", 50, 40, 80)):
        plan = plan_of(built)
        scans = re.findall(r"PushedFilters: (\[[^\n]*)", plan)
        assert scans and all("LessThanOrEqual(k," in x for x in scans), plan


def test_key_range_comes_from_footers(spark, tmp_path):
    corpus = stored(spark, tmp_path / "c", 300)
    assert P.key_range(corpus, "k") == (7, 7 + 3 * 299, 300)
    assert P.key_range(corpus, "t") is None and P.key_range(spark.range(5), "id") is None
    assert P.key_range(corpus.withColumn("other", F.col("k") * 2), "other") is None
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
