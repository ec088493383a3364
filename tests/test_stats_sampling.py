import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from narrascope.operators import sampling, stats


def test_text_column_by_name_then_by_length(spark):
    df = spark.createDataFrame([("a", "long text here", "d")], "n string, body string, dream string")
    assert stats.resolve_text_col(df) == "dream"
    assert stats.resolve_text_col(df.drop("dream")) == "body"
    with pytest.raises(ValueError):
        stats.resolve_text_col(spark.range(1))


def test_missing_texts_count_as_three_characters(spark):
    rows = [("x" * 10, "abcd")] + [(None, "abcd")] * 9
    df = spark.createDataFrame(rows, "sparse string, dense string")
    assert stats.resolve_text_col(df) == "dense"


def test_author_column_is_the_third(spark):
    df = spark.createDataFrame([("1", "t", "me")], "n string, dream string, who string")
    assert stats.resolve_author_col(df) == "who"
    assert stats.resolve_author_col(df.select("n", "dream")) is None


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [1.0, 2.0],
        [5.0, 1.0, 4.0],
        [random.Random(1).gauss(0, 1) for _ in range(5001)],
        [random.Random(2).gauss(0, 1) for _ in range(5000)],
        [0.0] * 3000 + [1.0] * 3000,
        [0.0] * 2000 + [random.Random(3).random() for _ in range(3000)],
        [7.0] * 4000,
        [float(i % 3) for i in range(6000)],
    ],
)
def test_exact_median_by_bracketing(spark, monkeypatch, values):
    """With a tiny driver bound every route of the search is taken."""
    monkeypatch.setattr(stats, "MEDIAN_COLLECT_ROWS", 10)
    monkeypatch.setattr(stats, "MEDIAN_ACCURACY", 50)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    assert stats.exact_median(df, "v") == statistics.median(values)


def test_median_ignores_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert stats.exact_median(df, "v") == 2.0
    assert stats.exact_median(df.limit(0), "v") is None
    labels = [r["split_label"] for r in stats.median_split(df.where("v = 1 OR v = 3"), "v").collect()]
    assert sorted(labels) == [stats.LOW_LABEL, stats.HIGH_LABEL]


def test_source_counts_has_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "source string")
    got = {(r["source"], r["n"], r["is_total"]) for r in stats.source_counts(df, "source").collect()}
    assert got == {("a", 2, False), ("b", 1, False), (None, 1, False), (None, 4, True)}


def test_values_without_a_number_have_no_side(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "v double")
    got = {(r["v"] if r["v"] == r["v"] else "nan"): r["split_label"] for r in stats.median_split(df, "v").collect()}
    assert got == {1.0: stats.LOW_LABEL, 3.0: stats.HIGH_LABEL, None: None, "nan": None}


def test_min_size(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, i int")
    got = {r["g"] for r in stats.groups_with_min_size(df, "g", 2).collect()}
    assert got == {"a"}


def by_hash(seed, keys):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 57, 2999, 3000, 5000])
@pytest.mark.parametrize("collect_rows", [2, 10_000])
def test_sample_is_exact(spark, monkeypatch, n, collect_rows):
    monkeypatch.setattr(sampling, "_COLLECT_ROWS", collect_rows)
    df = spark.range(3000).repartition(7)
    got = {r["id"] for r in sampling.sample_n(df, n, 42, "id").collect()}
    assert got == set(by_hash(42, range(3000))[:n])


def test_sample_depends_on_seed_only(spark):
    one_part = sampling.sample_n(spark.range(500).coalesce(1), 50, 1, "id").collect()
    many = sampling.sample_n(spark.range(500).repartition(9), 50, 1, "id").collect()
    other = sampling.sample_n(spark.range(500), 50, 2, "id").collect()
    assert set(one_part) == set(many) != set(other)


def test_top_k_with_a_hot_group(spark):
    """One group has most of the rows; results are those of a plain sort."""
    rows = [("hot" if i % 10 else f"g{i % 7}", i, (i * 7919) % 1000) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, id int, v int").repartition(16)
    got = sampling.top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 5).collect()
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:5]
        want |= {(g, r[1], i + 1) for i, r in enumerate(best)}
    assert {(r["g"], r["id"], r["rank"]) for r in got} == want


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = sampling.top_k_per_group(df, ["g"], [F.asc("id")], 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2
