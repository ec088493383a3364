import random

import pytest
from pyspark.sql import functions as F

from narrascope.operators import topics
from narrascope.plans.reports import topic_report

VOCABULARIES = (
    ["river", "water", "swim", "boat", "fish"],
    ["train", "ticket", "station", "track", "travel"],
    ["school", "teacher", "exam", "pupil", "lesson"],
)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    rows = [
        (i, " ".join(rng.choices(VOCABULARIES[i % 3], k=30)) + " the dream", f"a{i % 4}")
        for i in range(180)
    ]
    return spark.createDataFrame(rows, "n long, dream string, author string").repartition(4).cache()


def fit(planted):
    return topics.topics_fit(planted, "dream", k=3, max_iter=30, max_df=0.95)


def test_planted_topics_are_found(planted):
    model = fit(planted)
    assert set(model.terms) == {w for v in VOCABULARIES for w in v}  # stop words are out
    rows = model.assign(planted, "dream").collect()
    blocks = [{r["topic_id"] for r in rows if r["n"] % 3 == b} for b in range(3)]
    assert all(len(b) == 1 for b in blocks) and set.union(*blocks) == {1, 2, 3}
    assert all(abs(sum(r["topic_weights"]) - 1) < 1e-6 for r in rows)
    words = {}
    for r in model.top_words(5).collect():
        words.setdefault(r["topic_id"], set()).add(r["term"])
    assert sorted(map(sorted, words.values())) == sorted(map(sorted, VOCABULARIES))


def test_same_seed_same_topics(planted):
    first = [tuple(r) for r in fit(planted).keywords().orderBy("topic_id").collect()]
    again = [tuple(r) for r in fit(planted).keywords().orderBy("topic_id").collect()]
    assert first == again


def test_report(planted):
    report, _ = topic_report(planted, k=3, max_iter=30, max_df=0.95)
    rows = report.summary.collect()
    assert [r["dreams_count"] for r in rows] == [60, 60, 60]
    assert sum(r["total_words"] for r in rows) == 180 * 32
    assert all(r["dreamers_count"] == 4 and r["avg_words"] == 32.0 for r in rows)
    assert all(len(r["keywords"].split(", ")) == 10 for r in rows)
    facts = report.facts.select("topic_keywords").distinct().collect()
    assert all(len(r[0].split(", ")) == 3 for r in facts)


def test_vocabulary_bounds(spark):
    texts = ["apple banana"] * 3 + ["apple cherry"] * 2 + ["apple"] * 5 + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")

    def terms(**bounds):
        return [r["term"] for r in topics.vocabulary(df, "t", **bounds).collect()]

    assert terms(min_df=2, max_df=1.0) == ["apple", "banana", "cherry"]
    assert terms(min_df=3, max_df=1.0) == ["apple", "banana"]
    assert terms(min_df=2, max_df=0.9) == ["banana", "cherry"]
    assert terms(min_df=1, max_df=1.0, max_terms=1) == ["apple"]
    assert terms(min_df=2, max_df=0.9, stop_words=["banana"]) == ["cherry"]


def test_no_terms_left(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, t string")
    with pytest.raises(ValueError):
        topics.topics_fit(df, "t", k=2)


def test_default_stop_words(spark):
    words = set(topics.default_stop_words())
    assert {"the", "dream", "i", "awakened", "couldn"} <= words
    assert len(topics.EXTRA_STOP_WORDS) == 36


def test_dominant_topic_takes_the_first_maximum(one):
    assert one(topics.dominant_topic(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))) == 2
    assert one(topics.dominant_topic(F.array(F.lit(0.0), F.lit(0.0)))) == 1


def test_term_counts_do_not_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = topics.bag_of_words(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    stats_plan = topics.term_stats(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert stats_plan.count("Exchange") == 1


def test_the_fit_sees_every_report(spark):
    """A topic in one report of twenty is found in a large corpus, and no iteration samples."""
    df = spark.range(100_000).selectExpr(
        "case when id % 20 = 7 then 'harbour anchor sailor harbour anchor sailor harbour anchor sailor' "
        "when id % 2 = 0 then 'meadow flower garden meadow' else 'engine motor piston engine' end t"
    )
    model = topics.topics_fit(df, "t", k=3, max_iter=30, min_df=1, max_df=0.95)
    tops = [set() for _ in range(3)]
    for r in model.top_words(3).collect():
        tops[r["topic_id"] - 1].add(r["term"])
    assert {"harbour", "anchor", "sailor"} in tops
    assert model.lda.getSubsamplingRate() == 1.0
