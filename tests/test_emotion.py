import math

import pytest
from pyspark.sql import functions as F

from narrascope.operators import emotion
from narrascope.plans.reports import emotion_report


@pytest.mark.parametrize(
    "score, label",
    [
        (0.3, emotion.BLISSFUL),
        (0.2999, emotion.POSITIVE),
        (0.05, emotion.POSITIVE),
        (0.0499, emotion.NEUTRAL),
        (0.0, emotion.NEUTRAL),
        (-0.0499, emotion.NEUTRAL),
        (-0.05, emotion.NEGATIVE),
        (-0.3999, emotion.NEGATIVE),
        (-0.4, emotion.NIGHTMARE),
        (1.0, emotion.BLISSFUL),
        (-1.0, emotion.NIGHTMARE),
    ],
)
def test_label_edges(one, score, label):
    assert one(emotion.sentiment_label(F.lit(score))) == label


def test_keywords_are_substrings_counted_once(one):
    neg = emotion.NIGHTMARE_KEYWORDS
    assert one(emotion.keyword_count(F.lit("SCREAMING"), neg)) == 2
    assert one(emotion.keyword_count(F.lit("kill kill killed"), neg)) == 1
    assert one(emotion.keyword_count(F.lit("I enjoy"), emotion.BLISS_KEYWORDS)) == 1
    assert one(emotion.keyword_count(F.lit("we were running away"), neg)) == 1
    assert len(neg) == 28 and len(emotion.BLISS_KEYWORDS) == 21


@pytest.mark.parametrize("base, neg, pos, want", [(0.8, 0, 4, 1.0), (-0.8, 4, 0, -1.0), (0.1, 1, 2, 0.25)])
def test_hybrid_is_clamped(one, base, neg, pos, want):
    assert one(emotion.hybrid(F.lit(base), F.lit(neg), F.lit(pos))) == pytest.approx(want)


@pytest.fixture()
def scored_inputs(spark):
    reports = spark.createDataFrame(
        [
            (1, "good good morning", 1),
            (2, "bad monster blood", 2),
            (3, "plain", 1),
            (4, None, 1),
            (5, "bad monster blood", 2),
            (6, "...", None),
        ],
        "id long, dream string, topic_id int",
    )
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.5)], "word string, valence double")
    return reports, lexicon


def test_lexicon_score(scored_inputs):
    rows = emotion.lexicon_score(*scored_inputs, key="id", text_col="dream").collect()
    got = {r["id"]: r["base_score"] for r in rows}
    assert got[1] == pytest.approx(4 / math.sqrt(31)) and got[3] == 0.0 and got[6] == 0.0
    assert set(got) == {1, 2, 3, 5, 6}


def test_report(scored_inputs):
    report = emotion_report(*scored_inputs, key="id")
    dist = {r["sentiment_label"]: r for r in report.distribution.collect()}
    assert [r["label_order"] for r in report.distribution.collect()] == [1, 2, 3, 4, 5]
    assert dist[emotion.NIGHTMARE]["n"] == 2 and dist[emotion.NIGHTMARE]["bar"] == "█" * 8
    assert dist[emotion.POSITIVE]["n"] == 0 and dist[emotion.POSITIVE]["bar"] == ""
    topics = report.by_topic.collect()
    assert [r["topic_id"] for r in topics] == [2, 1]  # scariest first, null topic left out
    assert topics[0]["mood"] == "😱" and topics[0]["nightmare_count"] == 2
    assert topics[1]["mood"] == "😍" and topics[1]["total_dreams"] == 2
    ends = {r["kind"]: r["id"] for r in report.extremes.collect()}
    assert ends == {"happiest": 1, "scariest": 2}


def test_empty_corpus(scored_inputs):
    reports, lexicon = scored_inputs
    scored = emotion.hybrid_score(reports.limit(0), lexicon, "id", "dream")
    rows = emotion.sentiment_distribution(scored).collect()
    assert [r["n"] for r in rows] == [0] * 5 and [r["percent"] for r in rows] == [0.0] * 5


def test_rows_are_scored_one_by_one(spark):
    words = spark.createDataFrame([("good", 2.0), ("Good", 4.0), ("bad", -1.0), (None, 1.0)], "word string, valence double")
    rows = [(1, "good"), (1, "good"), (None, "bad bad"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    scored = emotion.hybrid_score(df, words, ["k"], "t")
    assert sorted(r["valence_sum"] for r in scored.collect()) == [-2.0, 0.0, 3.0, 3.0]
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_no_label_without_a_score(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.3,)], "s double")
    got = [r[0] for r in df.select(emotion.sentiment_label("s")).collect()]
    assert got == [None, None, emotion.BLISSFUL]


@pytest.mark.parametrize(
    "text, want",
    [
        ("good", 2.0),
        ("very good", 2.3),
        ("very, x good", 2 + 0.3 * 0.95),
        ("very x y good", 2 + 0.3 * 0.9),
        ("very x y z good", 2.0),
        ("very bad", -2.8),
        ("hardly bad", -2.3),
        ("not good", -1.48),
        ("NOT very good.", -0.74 * 2.3),
        ("x GOOD", 2.733),
        ("GOOD", 2.0),  # everything is capitalised, so nothing stands out
        ("x BAD", -3.233),
        ("good but bad", 1 - 3.75),
        ("but good but bad", 3 - 3.75),
        ("good!!", 2.584),
        ("bad!!!!!!", -2.5 - 4 * 0.292),
        ("nothing!!", 0.0),
        ("", 0.0),
        ("... !", 0.0),
        ("good " * 5_000, 10_000.0),
    ],
)
def test_rules(spark, text, want):
    lexicon = [("good", 2.0), ("Bad", -2.5)]
    rules = [("very", "booster", 0.3), ("hardly", "booster", -0.2), ("not", "negation", None), ("but", "contrast", None)]
    got = emotion.lexicon_score(
        spark.createDataFrame([(1, text), (2, "good not"), (3, None)], "id int, t string"),
        spark.createDataFrame(lexicon, "word string, valence double"),
        "id",
        "t",
        rules=spark.createDataFrame(rules, "word string, kind string, step double"),
    ).collect()
    sums = {r["id"]: r["valence_sum"] for r in got}
    assert sums == {1: pytest.approx(want, abs=1e-6), 2: 2.0}


def test_rules_of_unknown_kind(spark, scored_inputs):
    rules = spark.createDataFrame([("x", "other", 1.0)], "word string, kind string, step double")
    with pytest.raises(ValueError, match="unknown kind"):
        emotion.lexicon_score(*scored_inputs, key="id", text_col="dream", rules=rules)


def test_rules_on_no_reports(spark, scored_inputs):
    reports, lexicon = scored_inputs
    rules = spark.createDataFrame([], "word string, kind string, step double")
    assert emotion.lexicon_score(reports.limit(0), lexicon, "id", "dream", rules=rules).count() == 0
    a, b = (emotion.lexicon_score(reports, lexicon, "id", "dream", rules=r).collect() for r in (None, rules))
    assert sorted(a) == sorted(b)
