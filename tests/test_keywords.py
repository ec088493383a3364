import random

from narrascope.operators.keywords import keyword_counts, keyword_hits_many


def test_against_plain_containment(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abAB é", k=rng.randrange(0, 60))) for _ in range(80)] + [None, "", texts_of_old(rng)]
    words = ["".join(rng.choices("ab é", k=rng.randrange(1, 5))) for _ in range(60)] + ["AB", "ab", "", None, "ß"]
    rows = [(i % 70, f"s{i % 2}", t) for i, t in enumerate(texts)]  # repeated keys stay apart
    df = spark.createDataFrame(rows, "id long, keyword_source string, t string").repartition(5)
    keywords = spark.createDataFrame([(w, 1) for w in words], "keyword string, id int")
    wanted = {w.lower() for w in words if w}
    expected = sorted((i, s, w) for i, s, t in rows if t is not None for w in wanted if w in t.lower())
    for limit in (1000, 7):  # one list, and lists read one after the other
        got = keyword_hits_many(df, ["id", "keyword_source"], "t", keywords, max_rows=limit)
        assert sorted(map(tuple, got.collect())) == expected
        assert got.columns == ["id", "keyword_source", "keyword"]


def texts_of_old(rng):
    return "".join(rng.choices("ab ", k=300_000))


def test_no_keywords_and_no_reports(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    none = spark.createDataFrame([], "keyword string")
    assert keyword_hits_many(df, "id", "t", none).count() == 0
    assert keyword_hits_many(df.limit(0), "id", "t", df.selectExpr("t keyword")).count() == 0


def test_counts_and_no_shuffle_of_texts(spark):
    df = spark.createDataFrame([(1, "ab ab"), (2, "b")], "id long, t string")
    hits = keyword_hits_many(df, "id", "t", spark.createDataFrame([("b",), ("ab",)], "w string"), "w")
    assert [tuple(r) for r in keyword_counts(hits).collect()] == [("b", 2), ("ab", 1)]
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
