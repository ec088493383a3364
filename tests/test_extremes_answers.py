import json

import pytest
from pyspark.sql import functions as F

from narrascope.operators import answers, extremes
from narrascope.plans.reports import axis_export_report
from narrascope.sinks.tables import write_axis_export


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("vec_id"), "text"
    )
    rows = vectors.join(texts, "vec_id")
    return extremes.axis_extremes(rows, "vec_id", "embedding", 5, 20, rows, "text").cache()


def test_extremes(found, spark, sf_dir):
    rows = found.collect()
    assert len(rows) == 200
    top = [r for r in rows if r["axis_id"] == 1 and r["pole"] == "positive"]
    scores = [r["score"] for r in sorted(top, key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)
    low = [r["score"] for r in rows if r["axis_id"] == 1 and r["pole"] == "negative"]
    assert max(low) <= min(scores)


def test_rounds(found):
    first = extremes.make_rounds(found, "vec_id", 4, 42).collect()
    again = extremes.make_rounds(found.repartition(7), "vec_id", 4, 42).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 20
    assert {r["shown"] for r in first} == {"positive", "negative"}
    poles = {(r["axis_id"], r["vec_id"]): r["pole"] for r in found.collect()}
    for r in first:
        sides = [poles[(r["axis_id"], i)] for i in r["ids"]]
        assert sides.count(r["shown"]) == 3 and len(set(r["ids"])) == 4
        assert sides[r["correct"] - 1] != r["shown"] and len(r["texts"]) == 4


def test_export(spark, sf_dir, tmp_path):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("vec_id"), "text"
    )
    export = axis_export_report(vectors.join(texts, "vec_id"), "vec_id", "text", "stored", sample=150)
    write_axis_export(export, str(tmp_path / "out"))
    lines = [p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json")]
    data = json.loads("".join(lines))
    meta = data["metadata"]
    assert meta["n_dreams_sampled"] == 150 and meta["n_components"] == 5 and meta["model"] == "stored"
    assert meta["explained_variance"] == sorted(meta["explained_variance"], reverse=True)
    assert [a["axis_id"] for a in data["axes"]] == [1, 2, 3, 4, 5]
    for a in data["axes"]:
        assert a["label"] == f"PC{a['axis_id']}"
        assert a["explained_var"] == meta["explained_variance"][a["axis_id"] - 1]
        up = [d["score"] for d in a["positive_pole"]["dreams"]]
        down = [d["score"] for d in a["negative_pole"]["dreams"]]
        assert len(up) == len(down) == 20
        assert up == sorted(up, reverse=True) and down == sorted(down)
        assert set(a["positive_pole"]["dreams"][0]) == {"id", "text", "score"}


# Published accuracies in percent (without labels, with labels) per axis.
FACTS = {
    "a": ([70, 90, 80, 100, 100], [90, 100, 100, 100, 100]),
    "b": ([25, 35, 30, 45, 25], [75, 90, 65, 95, 90]),
    "c": ([10, 30, 25, 10, 10], [20, 20, 30, 10, 5]),
    "people": (None, [71, 71, 46, 76, 67]),
}


@pytest.fixture(scope="module")
def graded(spark):
    rows = []
    for responder, conditions in FACTS.items():
        for condition, values in zip(("no_labels", "with_labels"), conditions):
            for axis, percent in enumerate(values or [], 1):
                rows += [(responder, f"PC{axis}", condition, i < percent) for i in range(100)]
    return spark.createDataFrame(
        rows, "responder string, axis string, condition string, is_correct boolean"
    )


def test_accuracy_and_cross_tab(graded):
    rows = {(r["responder"], r["condition"], r["axis"]): r for r in answers.accuracy(graded).collect()}
    assert rows[("a", "no_labels", "overall")]["accuracy"] == pytest.approx(88)
    assert rows[("a", "no_labels", "overall")]["band"] == "high"
    assert rows[("people", "with_labels", "overall")]["accuracy"] == pytest.approx(66.2)
    assert rows[("people", "with_labels", "overall")]["band"] == "middle"
    assert rows[("c", "with_labels", "PC5")]["band"] == "low"
    wide = answers.accuracy_pivot(graded, ["PC1", "PC2", "PC3", "PC4", "PC5"])
    row = wide.where("responder = 'b' AND condition = 'no_labels'").first()
    assert [row[f"PC{i}"] for i in range(1, 6)] == pytest.approx([25, 35, 30, 45, 25])
    assert row["overall"] == pytest.approx(32)


def test_boost(graded):
    boost = {r["responder"]: r["boost"] for r in answers.label_boost(graded).collect()}
    assert boost["b"] == 51.0 and boost["c"] == 0.0 and boost["people"] is None


def test_vs_human(graded):
    gap = {(r["responder"], r["axis"]): r for r in answers.vs_human(graded, "people", answers.WITH_LABELS).collect()}
    assert gap[("a", "PC1")]["diff"] == 19.0 and gap[("a", "PC1")]["beats_human"]
    assert gap[("c", "PC5")]["diff"] == -62.0 and not gap[("c", "PC5")]["beats_human"]
    assert len(gap) == 15


def test_published_rounds(spark):
    """Keys and the panel's answers of the five published rounds."""
    keys, given = [1, 2, 1, 1, 2], [3, 2, 1, 1, 2]
    rounds = spark.createDataFrame(list(enumerate(keys)), "round_id int, correct int")
    rows = [(m, r, a) for m in ("a", "b", "c") for r, a in enumerate(given)]
    rows += [("best", r, k) for r, k in enumerate(keys)]
    rows += [("weak", r, k if r < 3 else 4) for r, k in enumerate(keys)]
    rows += [("lost", r, 4) for r in range(5)]
    table = spark.createDataFrame(rows, "responder string, round_id int, answer int")
    done = answers.grade(table, rounds)
    panel = answers.panel_accuracy(done.where("responder IN ('a', 'b', 'c')")).first()
    assert panel["panel_percent"] == 80.0 and panel["n_rounds"] == 5
    scores = {r["responder"]: r for r in answers.responder_scores(done).collect()}
    assert [scores[m]["band"] for m in ("best", "a", "weak", "lost")] == [
        "perfect",
        "high",
        "middle",
        "low",
    ]
    assert scores["a"]["score"] == 4 and scores["a"]["percent"] == 80.0
