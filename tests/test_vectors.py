import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from narrascope.functions import vectors as vx
from narrascope.operators import clusters, pca
from narrascope.plans.reports import semantic_map

RNG = np.random.default_rng(7)


def frame(spark, rows, group=None):
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    return df if group is None else df.withColumn("g", group)


@pytest.fixture(scope="module")
def cloud():
    """Correlated points far from the origin."""
    return (RNG.normal(size=(400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) + 4).astype(np.float32)


def test_quadrant_edges(spark):
    nan = float("nan")
    pts = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (-1.0, -1.0), (nan, 1.0), (None, 1.0), (1.0, nan)]
    df = spark.createDataFrame(pts, "x double, y double")
    names = [n for n, _ in vx.QUADRANTS]
    got = [r[0] for r in df.select(vx.quadrant("x", "y")).collect()]
    assert got == [names[3], names[1], names[2], names[0], names[3], None, None, None]


def test_clean_vector(one):
    v = F.array(*[F.lit(x) for x in (1.5, float("nan"), float("inf"), float("-inf"))])
    assert one(vx.clean_vector(v)) == [1.5, 0.0, vx.FLOAT32_MAX, -vx.FLOAT32_MAX]


def test_fit_matches_numpy_and_mllib(spark, cloud):
    df = frame(spark, cloud).repartition(5)
    model = pca.pca_fit(df, 3)
    cov = np.cov(cloud.astype(np.float64), rowvar=False)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert model.n == 400
    np.testing.assert_allclose(model.mean, cloud.astype(np.float64).mean(axis=0), rtol=1e-9)
    np.testing.assert_allclose(model.ratio, values[:3] / values.sum(), rtol=1e-8)
    np.testing.assert_allclose(model.loadings.T @ model.loadings, np.eye(3), atol=1e-9)
    peak = np.abs(model.loadings).argmax(axis=0)
    assert (model.loadings[peak, range(3)] > 0).all()
    ml = PCA(k=3, inputCol="v", outputCol="o").fit(df.select(array_to_vector("embedding").alias("v")))
    np.testing.assert_allclose(ml.explainedVariance.toArray(), model.ratio, rtol=1e-8)
    cos = np.abs((ml.pc.toArray() * model.loadings).sum(axis=0))
    np.testing.assert_allclose(cos, 1.0, rtol=1e-8)


def test_transform_is_centred(spark, cloud):
    df = frame(spark, cloud)
    model = pca.pca_fit(df, 2)
    rows = pca.pca_transform(df, model).orderBy("id").collect()
    got = np.array([[r["pca1"], r["pca2"]] for r in rows])
    np.testing.assert_allclose(got.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(got, (cloud - model.mean) @ model.loadings, atol=1e-9)


def test_groups_equal_separate_fits(spark, cloud):
    df = frame(spark, cloud).withColumn("g", F.when(F.col("id") < 300, "big").otherwise("small"))
    models = pca.pca_fit_by(df, "g", 2)
    for g in ("big", "small"):
        alone = pca.pca_fit(df.where(F.col("g") == g), 2)
        np.testing.assert_allclose(models[g].loadings, alone.loadings, atol=1e-9)
        np.testing.assert_allclose(models[g].ratio, alone.ratio, rtol=1e-9)
    out = pca.pca_transform(df, models, ("a", "b"), group="g")
    means = out.groupBy("g").agg(F.avg("a").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in means)


def test_small_groups_have_no_model(spark, cloud):
    df = frame(spark, cloud[:15]).withColumn("g", F.when(F.col("id") < 12, "a").otherwise("b"))
    models = pca.pca_fit_by(df, "g", 2, min_rows=10)
    assert set(models) == {"a"}
    out = pca.pca_transform(df, models, ("p", "q"), group="g")
    assert out.where("g = 'b' AND p IS NULL").count() == 3
    assert out.where("g = 'a' AND p IS NOT NULL").count() == 12


def test_bad_vectors(spark):
    df = frame(spark, [[1, 2], [3, float("nan")], [float("inf"), 1]] * 5)
    assert np.isfinite(pca.pca_fit(df, 1).loadings).all()
    ragged = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(Exception, match="different lengths|Dimensions mismatch"):
        pca.pca_fit(ragged, 1)
    with pytest.raises(ValueError):
        pca.pca_fit(df.limit(0), 1)


def test_null_vectors_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    model = pca.pca_fit(df, 1)
    assert model.n == 3
    got = {r["id"]: r["pca1"] for r in pca.pca_transform(df, model, ("pca1",)).collect()}
    assert got[2] is None and all(got[i] is not None for i in (1, 3, 4))


def test_partitions_do_not_matter(spark, cloud):
    one = pca.pca_fit(frame(spark, cloud).coalesce(1), 2)
    many = pca.pca_fit(frame(spark, cloud).repartition(8), 2)
    np.testing.assert_allclose(one.loadings, many.loadings, atol=1e-9)


def planted():
    centres = np.eye(4) * 10
    return np.concatenate([c + RNG.normal(scale=0.1, size=(30, 4)) for c in centres])


def test_planted_clusters(spark):
    df = frame(spark, planted()).withColumn("g", F.lit("one"))
    centres = clusters.kmeans_fit_by(df, "g", k=4)["one"]
    rows = clusters.kmeans_assign(df, {"one": centres}, group="g").collect()
    blocks = [{r["cluster"] for r in rows if r["id"] // 30 == b} for b in range(4)]
    assert all(len(b) == 1 for b in blocks) and len(set.union(*blocks)) == 4
    for r in rows:
        distance = ((np.asarray(r["embedding"]) - centres) ** 2).sum(axis=1)
        assert distance.argmin() == r["cluster"]


def test_group_needs_more_rows_than_clusters(spark):
    df = frame(spark, planted()).withColumn("g", F.when(F.col("id") < 4, "few").otherwise("many"))
    out = clusters.kmeans_by(df, "g", k=4)
    assert out.where("g = 'few' AND cluster IS NOT NULL").count() == 0
    sizes = clusters.cluster_sizes(out).collect()
    assert [r["cluster"] for r in sizes] == [0, 1, 2, 3] and sum(r["n"] for r in sizes) == 116


def test_ties_go_to_the_first_centre(spark):
    df = frame(spark, [[0.0, 0.0]])
    assert clusters.kmeans_assign(df, [[1, 0], [-1, 0], [0, 1]]).first()["cluster"] == 0


def test_semantic_map(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = semantic_map(vectors, "vec_id", sample=300)
    rows = found.points.collect()
    assert len(rows) == 300 and found.model.n == 300
    names = {n for n, _ in vx.QUADRANTS}
    assert {r["quadrant"] for r in rows} == names == set(found.local_models)
    for q in names:
        assert {r["cluster"] for r in rows if r["quadrant"] == q} == {0, 1, 2, 3}


def test_a_thousand_groups_in_one_fit(spark):
    """Two blobs in each of 1,000 groups and a big group with a third of the rows; no group lacks its clusters."""
    df = spark.range(12_000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('g', id % 1000) end g", "cast(id div 1000 % 2 as int) side",
        "array(cast(id div 1000 % 2 * 10 + (id % 7) * 0.01 as double), cast((id % 5) * 0.01 as double)) embedding",
    )
    out = clusters.kmeans_by(df, "g", k=2)
    per_side = out.groupBy("g", "side").agg(F.countDistinct("cluster").alias("n"), F.min("cluster").alias("c"))
    rows = per_side.collect()
    assert len(rows) == 2 * 1001 and all(r["n"] == 1 and r["c"] is not None for r in rows)
    assert len({(r["g"], r["c"]) for r in rows}) == 2 * 1001


def test_fit_does_not_depend_on_partitions(spark):
    df = spark.range(900).selectExpr(
        "case when id % 4 = 0 then 'a' else 'b' end g", "array(sin(id), cos(id * 3), id % 11 / 5.0) embedding"
    )
    one = clusters.kmeans_fit_by(df.coalesce(1), "g", k=3)
    many = clusters.kmeans_fit_by(df.repartition(20), "g", k=3)
    assert one.keys() == many.keys() and all(np.allclose(one[g], many[g], atol=1e-9) for g in one)


def test_seeds_follow_the_distance(spark):
    """Copies of few vectors: every different vector is drawn once, then equal centres remain."""
    df = spark.range(300).selectExpr("'x' grp", "array(cast(case when id < 290 then 0 else id % 2 + 1 end as double)) v")
    drawn = clusters.seed_centres(df, ["x"], 4, 1)["x"].ravel().tolist()
    assert sorted(set(drawn)) == [0.0, 1.0, 2.0] and len(drawn) == 4
    assert clusters.seed_centres(df.limit(0), ["x"], 4, 1) == {}


@pytest.mark.parametrize("parts", [1, 9])
def test_large_means_cost_no_digits(spark, parts):
    """Vectors shifted by far more than their spread have the same components and shares."""
    cloud = np.random.default_rng(5).normal(size=(3_000, 4)) @ np.diag([3.0, 2.0, 1.0, 0.5])
    # Whole multiples of a power of two, so that the shift itself is exact.
    cloud = np.round(cloud * 1024) / 1024
    rows = [(i, "a" if i % 3 else "b", v.tolist()) for i, v in enumerate(cloud)]
    df = spark.createDataFrame(rows, "id long, g string, embedding array<double>").repartition(parts)
    far = df.withColumn("embedding", F.transform("embedding", lambda x: x + 2.0**23))
    for near_model, far_model in zip(*(sorted(pca.pca_fit_by(d, "g", 4).items()) for d in (df, far))):
        (g, a), (h, b) = near_model, far_model
        assert g == h and a.n == b.n == {"a": 2_000, "b": 1_000}[g]
        np.testing.assert_allclose(b.ratio, a.ratio, rtol=1e-9)
        np.testing.assert_allclose(b.loadings, a.loadings, atol=1e-9)
        np.testing.assert_allclose(b.mean - 2.0**23, a.mean, atol=1e-7)


def test_groups_with_vectors_of_different_lengths(spark):
    rows = [("a", [float(i), float(i % 3)]) for i in range(40)] + [("b", [float(i % 5), float(i), 1.0]) for i in range(40)]
    models = pca.pca_fit_by(spark.createDataFrame(rows, "g string, embedding array<double>"), "g", 1)
    assert {g: m.mean.size for g, m in models.items()} == {"a": 2, "b": 3}


def test_few_rows_take_few_tasks_per_iteration(spark, monkeypatch):
    tasks, step = [], clusters.lloyd_step
    monkeypatch.setattr(clusters, "lloyd_step", lambda rows, centres: tasks.append(rows.rdd.getNumPartitions()) or step(rows, centres))
    df = spark.createDataFrame([("a", [float(i % 7), float(i % 5)]) for i in range(70)], "g string, embedding array<double>")
    parts = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    spark.conf.set(parts, "40")
    try:
        clusters.kmeans_fit_by(df, "g", k=2)
    finally:
        spark.conf.set(parts, before)
    assert set(tasks) == {spark.sparkContext.defaultParallelism}
