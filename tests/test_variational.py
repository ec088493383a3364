import math
import random
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from narrascope.functions import text as tx
from narrascope.operators import emotion
from narrascope.operators import variational as vb

VOCABULARIES = (
    ["river", "water", "swim", "boat", "fish"],
    ["train", "ticket", "station", "track", "travel"],
    ["school", "teacher", "exam", "pupil", "lesson"],
)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(VOCABULARIES[i % 3], k=5 + i % 40)) + " the dream", "x") for i in range(180)]
    rows += [(180, None, "x"), (181, "", "x"), (182, "unknown only", "x"), (0, rows[0][1], "x")]
    return spark.createDataFrame(rows, "n long, dream string, terms string").repartition(4).cache()


@pytest.fixture(scope="module")
def fitted(planted):
    return vb.topics_fit_batch(planted, "dream", k=3, max_iter=40, max_df=0.95, tolerance=1e-6, min_gain=1e-9)


def test_gamma_functions():
    x = np.array([1e-3, 0.01, 0.5, 1.0, 2.5, 40.0, 1e6])
    assert np.allclose(vb.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    slope = [(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x]
    assert np.allclose(vb.digamma(x), slope, rtol=1e-6)
    assert abs(vb.digamma(np.array(1.0)) + 0.5772156649015329) < 1e-12


def test_planted_topics_are_found(planted, fitted):
    assert set(fitted.terms) == {w for v in VOCABULARIES for w in v}
    rows = fitted.assign(planted, "dream").collect()
    assert sorted(r["n"] for r in rows) == sorted([0, *range(180), 181, 182])  # null text is left out
    blocks = [{r["topic_id"] for r in rows if r["n"] < 180 and r["n"] % 3 == b} for b in range(3)]
    assert all(len(b) == 1 for b in blocks) and set.union(*blocks) == {1, 2, 3}
    assert all(abs(sum(r["topic_weights"]) - 1) < 1e-9 and r["terms"] == "x" for r in rows)
    assert all(r["topic_weights"] == [1 / 3] * 3 for r in rows if r["n"] > 180)
    words = {}
    for r in fitted.top_words(5).collect():
        words.setdefault(r["topic_id"], set()).add(r["term"])
    assert sorted(map(sorted, words.values())) == sorted(map(sorted, VOCABULARIES))


def test_the_bound_never_falls(fitted):
    steps = np.diff(fitted.bounds)
    assert len(steps) > 3 and (steps > -1e-6 * abs(fitted.bounds[0])).all()


def test_one_pass_by_hand(spark):
    """A pass against plain loops, with texts of very different lengths and repeated texts."""
    texts = ["aaa bbb", "aaa aaa ccc", "bbb ccc ccc ddd", "aaa bbb", "aaa " * 3000 + "ddd", "", "zzz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    terms = ["aaa", "bbb", "ccc", "ddd"]
    start = np.array([[1.0, 2.0, 3.0, 1.5], [2.0, 1.0, 1.0, 2.5]])
    got, bound = vb.topics_step(vb.count_features(df, "t", terms), start, 0.5, 0.25, steps=4, tolerance=0.0)
    beta = np.exp(vb.expected_log(start))
    expected = np.full((2, 4), 0.25)
    for text in texts:
        counts = [text.split().count(t) for t in terms]
        gamma = [1.0, 1.0]
        for step in range(5):
            theta = np.exp(vb.expected_log(np.array(gamma)))
            phi = [[theta[z] * beta[z][w] / sum(theta[y] * beta[y][w] for y in range(2)) for w in range(4)] for z in range(2)]
            if step < 4:
                gamma = [0.5 + sum(counts[w] * phi[z][w] for w in range(4)) for z in range(2)]
        expected += np.array([[counts[w] * phi[z][w] for w in range(4)] for z in range(2)])
    assert np.allclose(got, expected, rtol=1e-9) and np.isfinite(bound)


def test_partitions_do_not_matter(spark, planted):
    terms = sorted(w for v in VOCABULARIES for w in v)
    start = np.random.default_rng(1).gamma(100.0, 0.01, (3, len(terms)))
    one, b1 = vb.topics_step(vb.count_features(planted.coalesce(1), "dream", terms), start, 0.3, 0.3)
    many, b2 = vb.topics_step(vb.count_features(planted.repartition(40), "dream", terms), start, 0.3, 0.3)
    assert np.allclose(one, many, rtol=1e-9) and abs(b1 - b2) < 1e-6 * abs(b1)


def test_no_reports_and_no_terms(spark):
    empty = spark.createDataFrame([], "t string")
    start = np.ones((2, 1))
    weights, _ = vb.topics_step(vb.count_features(empty, "t", ["aaa"]), start, 0.5, 0.5)
    assert weights.tolist() == [[0.5], [0.5]]
    with pytest.raises(ValueError):
        vb.topics_fit_batch(empty, "t", k=2)


@pytest.mark.parametrize("sharp", [0.01, 100.0])
def test_topics_at_the_prior_change_nothing(sharp):
    """Parameters of every report against plain loops over all topics; most are soon left out of the products."""
    rng = np.random.default_rng(4)
    k, n_terms, prior = 100, 300, 0.01
    job = vb._Inference(np.exp(vb.expected_log(rng.gamma(sharp, 1 / sharp, (k, n_terms)) + 0.01)).T.copy(), prior, 100, 1e-3)
    ids = [np.sort(rng.choice(n_terms, size, replace=False)) for size in (*rng.integers(30, 41, 80), 0)]
    counts = [rng.integers(1, 9, len(i)).astype(float) for i in ids]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    seen, cells = 0, 0
    plain_matmul = np.matmul

    def counted(a, b):
        nonlocal cells
        cells += max(a.size, b.size)
        return plain_matmul(a, b)

    wanted, plain_cells = {}, 0
    for i, (at, cnt) in enumerate(zip(ids, counts)):
        gamma = np.ones(k)
        for _ in range(100 if len(at) else 0):
            theta = np.exp(vb.digamma(gamma))
            new = prior + theta * ((cnt / (job.beta[at] @ theta)) @ job.beta[at])
            plain_cells += 2 * len(at) * k
            gamma, change = new, np.abs(new - gamma).mean()
            if change <= 1e-3:
                break
        wanted[i] = gamma
    vb.np.matmul = counted
    try:
        for rows, _, _, gamma in job.blocks(offsets, np.concatenate(ids), np.concatenate(counts)):
            seen += len(rows)
            assert np.allclose(gamma, [wanted[r] for r in rows], rtol=1e-8)
    finally:
        vb.np.matmul = plain_matmul
    assert seen == len(ids) - 1 and (sharp < 1 or cells < 0.8 * plain_cells)


def test_bags_are_those_of_the_expression(spark, planted):
    """Terms and counts from Arrow batches against the column expression, with empty texts and stop words."""
    odd = spark.createDataFrame([("",), (None,), ("the the",), ("Zoo zoo aÉb K\u212ait ab abc",)], "dream string")
    for df in (odd, odd.limit(0), planted.select("dream")):
        for mode, stop in (("alpha3", ["the"]), ("word", [])):
            bag = tx.bag(tx.without(tx.tokens("dream", mode), stop))
            wanted = df.where("dream is not null").select("dream", bag.alias("b")).select("dream", "b.term", "b.cnt")
            found = vb.with_bags(df, "dream", mode, stop).select("dream", "bag.term", "bag.cnt")
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_stored_bags_serve_fit_and_assignment(spark, planted, fitted, tmp_path):
    """Without any text: the same topics and weights as from the texts."""
    vb.with_bags(planted, "dream").drop("dream").write.parquet(f"{tmp_path}/bags")
    stored = spark.read.parquet(f"{tmp_path}/bags")
    model = vb.topics_fit_batch(stored, None, k=3, max_iter=40, max_df=0.95, tolerance=1e-6, min_gain=1e-9, bag_col="bag")
    assert model.terms == fitted.terms and np.allclose(model.weights, fitted.weights, rtol=1e-6)
    plain = {r["n"]: r["topic_weights"] for r in fitted.assign(planted, "dream").collect()}
    found = model.assign(stored, None, "bag").select("n", "topic_weights", "topic_id").collect()
    assert sorted(r["n"] for r in found) == sorted([0, *range(180), 181, 182])
    assert all(np.allclose(r["topic_weights"], plain[r["n"]], atol=1e-6) for r in found)


def test_exp_of_digamma():
    x = np.array([1e-3, 0.01, 0.1, 0.5, 1.0, 2.5, 40.0, 1e4, 1e6])
    assert np.allclose(vb.exp_digamma(x)[2:], np.exp(vb.digamma(x))[2:], rtol=1e-12, atol=0)
    assert np.allclose(vb.exp_digamma(x), np.exp(vb.digamma(x)), rtol=1e-9, atol=0)


def test_batches_are_inferred_together(monkeypatch):
    """Sixteen short Arrow batches take as many products as one with all of their reports, and give the same sums."""
    rng = np.random.default_rng(6)
    job = vb._Inference(np.exp(vb.expected_log(rng.gamma(100, 0.01, (20, 60)))).T.copy(), 0.05, 100, 1e-3)
    ids = [np.sort(rng.choice(60, size, replace=False)).tolist() for size in rng.integers(0, 30, 128)]
    counts = [rng.integers(1, 5, len(i)).astype(float).tolist() for i in ids]
    monkeypatch.setattr(vb, "TaskContext", mock.Mock(**{"get.return_value.partitionId.return_value": 0}))

    def sums(rows):
        kinds = pa.list_(pa.int32()), pa.list_(pa.float64())
        cut = [(pa.array(ids[i : i + rows], kinds[0]), pa.array(counts[i : i + rows], kinds[1])) for i in range(0, 128, rows)]
        with mock.patch.object(vb.np, "matmul", wraps=np.matmul) as products:
            (found,) = job.sums(pa.RecordBatch.from_arrays([*x], ["ids", "counts"]) for x in cut)
        return np.array(found.column(1)[0].as_py()), products.call_count

    (short, many), (whole, one) = sums(8), sums(128)
    assert np.allclose(short, whole, rtol=1e-12) and many == one


def test_texts_travel_in_short_batches(spark, planted):
    """Else a batch, and the memory of a worker, grows with the rows of a task; a number set by the user stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(rows)
    vb.count_features(planted, "dream", ["river"])
    assert spark.conf.get(rows) == "1024"
    spark.conf.unset(rows)
    emotion.lexicon_score(planted, spark.createDataFrame([("river", 1.0)], "word string, valence double"), "n", "dream")
    assert spark.conf.get(rows) == "1024"
    spark.conf.set(rows, "77")
    vb.count_features(planted, "dream", ["river"])
    assert spark.conf.get(rows) == "77"
    spark.conf.unset(rows)
