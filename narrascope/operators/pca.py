"""Principal components of a vector column, for all rows or for every group in one pass.

Each task reduces its rows to one row per group (count, mean, upper triangle of the centred cross
products), so what is shuffled depends on the number of tasks and groups and not on the number of rows.
A group that holds most of the rows is no burden for one task. Nothing is ever subtracted from a sum of
squares, so means that are large against the spread cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions.sizing import materialize, small_table
from narrascope.functions.vectors import matrix, project

_MERGE_SALTS = 32
# A task hands its sums on when it holds this many groups, so that its memory stays bounded.
_GROUPS_PER_FLUSH = 64
_PARTIAL = "grp string, salt int, n long, mean array<double>, cross array<double>"
_CENTRED = "grp string, salt int, n long, centre array<double>, cross array<double>"
_FITTED = (
    "grp string, n long, mean array<double>, loadings array<double>, "
    "variance array<double>, total_variance double"
)


@dataclass(frozen=True)
class PcaModel:
    """Mean, loadings (length x k), explained variance and its share of the total."""

    n: int
    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    total_variance: float


def _partial_rows(moments: dict[str, list]) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % _MERGE_SALTS
    doubles = pa.list_(pa.float64())
    for name, (n, mean, cross) in moments.items():
        yield pa.RecordBatch.from_pydict(
            {
                "grp": pa.array([name], pa.string()),
                "salt": pa.array([salt], pa.int32()),
                "n": pa.array([n], pa.int64()),
                "mean": pa.array([mean], doubles),
                "cross": pa.array([cross[np.triu_indices(mean.size)]], doubles),
            }
        )
    moments.clear()


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moments: dict[str, list] = {}
    for batch in batches:
        groups = np.asarray(batch.column(0).to_pandas(), dtype=object)
        vectors = batch.column(1)
        for name in set(groups.tolist()):
            rows = matrix(vectors.take(pa.array(np.flatnonzero(groups == name))))
            m = moments.setdefault(name, [0, np.zeros(rows.shape[1]), np.zeros((rows.shape[1],) * 2)])
            if rows.shape[1] != m[1].size:
                raise ValueError("vectors of different lengths")
            mean = rows.mean(axis=0)
            centred = rows - mean
            n, step = m[0] + len(rows), mean - m[1]
            m[2] += centred.T @ centred + np.outer(step, step) * (m[0] * len(rows) / n)
            m[1] = m[1] + step * (len(rows) / n)
            m[0] = n
            if len(moments) >= _GROUPS_PER_FLUSH:
                yield from _partial_rows(moments)
    yield from _partial_rows(moments)


def _recentred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cross products about the mean of the whole group in place of that of a task's part of it."""
    for batch in batches:
        cross = []
        for k in range(len(batch)):  # one by one, as groups may have vectors of different lengths
            mean, centre, own = (matrix(batch.column(c).slice(k, 1))[0] for c in ("mean", "centre", "cross"))
            i, j = np.triu_indices(mean.size)
            step = mean - centre
            cross.append(own + batch.column("n")[k].as_py() * step[i] * step[j])
        kept = [batch.column(c) for c in ("grp", "salt", "n", "centre")]
        lists = pa.array(cross, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*kept, lists], names=["grp", "salt", "n", "centre", "cross"])


def _moments(df: DataFrame, vector_col: str, group: str | None) -> DataFrame:
    """(grp, n, mean, cross) with one row per group; merged in two steps to keep every task small."""
    g = F.lit("") if group is None else F.col(group).cast("string")
    rows = df.select(g.alias("grp"), F.col(vector_col).alias("v")).where(
        F.col("grp").isNotNull() & F.col("v").isNotNull()
    )
    partial = materialize(rows.mapInArrow(_partial_moments, _PARTIAL), "moments")
    sums = Summarizer.sum(array_to_vector("mean"), F.col("n").cast("double")).alias("total")
    salted = partial.groupBy("grp", "salt").agg(F.sum("n").alias("n"), sums)
    whole = salted.groupBy("grp").agg(F.sum("n").alias("_n"), Summarizer.sum(F.col("total")).alias("total"))
    centre = F.transform(vector_to_array("total"), lambda x: x / F.col("_n")).alias("centre")
    # Per salt, so that the join spreads the parts of a large group.
    salts = F.explode(F.sequence(F.lit(0), F.lit(_MERGE_SALTS - 1))).alias("salt")
    centres = whole.select("grp", centre).select("grp", "centre", salts)
    about = partial.join(centres, ["grp", "salt"]).select("grp", "salt", "n", "mean", "centre", "cross")
    about = about.mapInArrow(_recentred, _CENTRED).withColumn("cross", array_to_vector("cross"))
    added = (F.sum("n").alias("n"), F.first("centre").alias("centre"), Summarizer.sum(F.col("cross")).alias("cross"))
    merged = about.groupBy("grp", "salt").agg(*added).groupBy("grp").agg(*added)
    return merged.select("grp", "n", F.col("centre").alias("mean"), vector_to_array("cross").alias("cross"))


def _covariance(row: dict) -> np.ndarray:
    """Sample covariance of a group."""
    d = len(row["mean"])
    cross = np.zeros((d, d))
    cross[np.triu_indices(d)] = row["cross"]
    return (cross + np.triu(cross, 1).T) / max(row["n"] - 1, 1)


def _eigen(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("grp", "n", "mean", "loadings", "variance", "total")}
            for row in batch.to_pylist():
                mean, cov = np.asarray(row["mean"]), _covariance(row)
                values, vectors = np.linalg.eigh(cov)
                top = np.argsort(values)[::-1][: min(k, len(mean))]
                loadings = vectors[:, top]
                peak = np.abs(loadings).argmax(axis=0)
                loadings = loadings * np.sign(loadings[peak, np.arange(loadings.shape[1])])
                out["grp"].append(row["grp"])
                out["n"].append(row["n"])
                out["mean"].append(mean)
                out["loadings"].append(loadings.ravel())
                out["variance"].append(np.maximum(values[top], 0.0))
                out["total"].append(float(np.trace(cov)))
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_pydict(
                {
                    "grp": pa.array(out["grp"], pa.string()),
                    "n": pa.array(out["n"], pa.int64()),
                    "mean": pa.array(out["mean"], doubles),
                    "loadings": pa.array(out["loadings"], doubles),
                    "variance": pa.array(out["variance"], doubles),
                    "total_variance": pa.array(out["total"], pa.float64()),
                }
            )

    return run


def pca_fit_by(
    df: DataFrame, group: str | None, k: int = 2, vector_col: str = "embedding", min_rows: int = 10
) -> dict[str, PcaModel]:
    """A model per group with at least `min_rows` rows; the sign makes the largest loading positive.

    The data are read once for all groups. The decomposition of a group's small matrix runs in a
    task too; the driver receives the mean and k loadings of each group.
    """
    fitted = (
        _moments(df, vector_col, group)
        .where(F.col("n") >= min_rows)
        .mapInArrow(_eigen(k), _FITTED)
    )
    models = {}
    for r in fitted.collect():
        mean = np.asarray(r["mean"])
        variance = np.asarray(r["variance"])
        total = r["total_variance"]
        models[r["grp"]] = PcaModel(
            r["n"],
            mean,
            np.asarray(r["loadings"]).reshape(mean.size, -1),
            variance,
            variance / total if total > 0 else np.zeros_like(variance),
            total,
        )
    return models


def pca_fit(df: DataFrame, k: int = 2, vector_col: str = "embedding") -> PcaModel:
    models = pca_fit_by(df, None, k, vector_col, min_rows=1)
    if not models:
        raise ValueError("no vectors to fit")
    return models[""]


def pca_transform(
    df: DataFrame,
    model: PcaModel | dict[str, PcaModel],
    names: Sequence[str] = ("pca1", "pca2"),
    vector_col: str = "embedding",
    group: str | None = None,
) -> DataFrame:
    """`df` with centred coordinates; rows of groups without a model get null coordinates."""
    models = model if isinstance(model, dict) else {"": model}
    coords = project(
        vector_col,
        {g: m.loadings[:, : len(names)] for g, m in models.items()},
        {g: m.mean for g, m in models.items()},
        group,
    )
    return with_coordinates(df, coords, names)


def with_coordinates(df: DataFrame, coords, names: Sequence[str]) -> DataFrame:
    """Spread an array of coordinates over named columns."""
    out = df.withColumn("_coords", coords)
    return out.withColumns({n: F.get("_coords", F.lit(i)) for i, n in enumerate(names)}).drop(
        "_coords"
    )


def pca_variance(spark: SparkSession, models: dict[str, PcaModel]) -> DataFrame:
    """(grp, component, variance_ratio, cumulative_ratio, n) of fitted models."""
    rows = [
        (g, i + 1, float(r), float(m.ratio[: i + 1].sum()), m.n)
        for g, m in sorted(models.items())
        for i, r in enumerate(m.ratio)
    ]
    return small_table(
        spark, rows, "grp string, component int, variance_ratio double, cumulative_ratio double, n long"
    )


def covariance(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Entries (i, j, cov) of the sample covariance for i <= j, from the same moments."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cov = _covariance(row)
                i, j = np.triu_indices(len(cov))
                yield pa.RecordBatch.from_pydict(
                    {
                        "i": pa.array(i + 1, pa.int32()),
                        "j": pa.array(j + 1, pa.int32()),
                        "cov": pa.array(cov[i, j], pa.float64()),
                    }
                )

    return _moments(df, vector_col, None).mapInArrow(entries, "i int, j int, cov double")



def mean_vector(df: DataFrame, vector_col: str = "embedding") -> np.ndarray:
    """Mean of a vector column, summed in the JVM; one vector reaches the driver."""
    vectors = df.where(F.col(vector_col).isNotNull()).select(
        array_to_vector(F.col(vector_col).cast("array<double>")).alias("v")
    )
    return vectors.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
