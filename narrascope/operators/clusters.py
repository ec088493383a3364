"""Clusters inside groups: one fit of all groups at once, assignment to centres, cluster sizes.

A pass over the rows serves every group. Each task adds up one row per (group, cluster) it has met, so what
is shuffled depends on tasks, groups and clusters and not on the number of rows, and a group that holds most
of the rows is no burden for one task. The centres, groups x k vectors, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.sizing import dealt_out, materialize
from narrascope.functions.vectors import clean_vector, group_rows, matrix, nearest_centre
from narrascope.operators.stats import count_by

Centres = dict[str, np.ndarray]

_MERGE_SALTS = 32
# Rows of a task that is run once per iteration; with few rows, starting tasks takes most of the time.
_TASK_ROWS = 50_000
# A task hands its sums on when it holds this many groups, so that its memory stays bounded.
_GROUPS_PER_FLUSH = 256
_TOLERANCE = 1e-4
_PARTIAL = "grp string, cluster int, salt int, n long, stats array<double>"


def _group_vectors(df: DataFrame, group: str | None, vector_col: str) -> DataFrame:
    """(grp, v) of the rows that have both; NaN and infinite entries replaced."""
    g = F.lit("") if group is None else F.col(group).cast("string")
    rows = df.select(g.alias("grp"), F.col(vector_col).alias("v"))
    return rows.where("grp is not null and v is not null").withColumn("v", clean_vector("v").cast("array<double>"))


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _cluster_sums(centres: Centres):
    """Count and sum of the rows nearest to each centre; groups without centres are skipped."""

    def flush(sums: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % _MERGE_SALTS
        found = [(g, c, n[c], total[c]) for g, (n, total) in sums.items() for c in np.flatnonzero(n)]
        sums.clear()
        yield pa.RecordBatch.from_pydict(
            {
                "grp": pa.array([f[0] for f in found], pa.string()),
                "cluster": pa.array([f[1] for f in found], pa.int32()),
                "salt": pa.array([salt] * len(found), pa.int32()),
                "n": pa.array([f[2] for f in found], pa.int64()),
                "stats": pa.array([f[3] for f in found], pa.list_(pa.float64())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple] = {}
        for batch in batches:
            for name, at in group_rows(batch.column(0)):
                if name not in centres:
                    continue
                rows = matrix(batch.column(1).take(pa.array(at)))
                near = _distances(rows, centres[name]).argmin(axis=1)
                n, total = sums.setdefault(
                    name, (np.zeros(len(centres[name]), dtype=np.int64), np.zeros_like(centres[name]))
                )
                n += np.bincount(near, minlength=len(n))
                np.add.at(total, near, rows)
                if len(sums) >= _GROUPS_PER_FLUSH:
                    yield from flush(sums)
        yield from flush(sums)

    return run


def lloyd_step(rows: DataFrame, centres: Mapping[str, np.ndarray]) -> tuple[Centres, dict[str, np.ndarray]]:
    """One iteration over (grp, v): the means of all clusters of all groups, and their numbers of rows.

    A row belongs to its nearest centre, the lowest one among equals. A centre without rows stays.
    """
    given = {g: np.asarray(c, dtype=np.float64) for g, c in centres.items()}
    partial = rows.mapInArrow(_cluster_sums(given), _PARTIAL).withColumn("stats", array_to_vector("stats"))
    sums = [F.sum("n").alias("n"), Summarizer.sum(F.col("stats")).alias("stats")]
    merged = partial.groupBy("grp", "cluster", "salt").agg(*sums).groupBy("grp", "cluster").agg(*sums)
    moved = {g: c.copy() for g, c in given.items()}
    counts = {g: np.zeros(len(c), dtype=np.int64) for g, c in given.items()}
    for r in merged.withColumn("stats", vector_to_array("stats")).toLocalIterator():
        moved[r["grp"]][r["cluster"]] = np.asarray(r["stats"]) / r["n"]
        counts[r["grp"]][r["cluster"]] = r["n"]
    return moved, counts


def _least_distance(centres: Centres) -> Column:
    @F.arrow_udf("double")
    def run(groups: pa.Array, vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(groups))
        for name, at in group_rows(groups):
            if name in centres:
                out[at] = _distances(matrix(vectors.take(pa.array(at))), centres[name]).min(axis=1)
        return pa.array(out, pa.float64())

    return run.asNondeterministic()("grp", "v")


def seed_centres(rows: DataFrame, groups: Sequence[str], k: int, seed: int) -> Centres:
    """k rows per group, drawn one after the other with chances in proportion to the squared distance from
    the nearest row already drawn.

    The draw is the least of -ln(u) / distance with u from a hash of the vector, so it is exact, the same for
    any partitioning, and one aggregation per centre for all groups together. Copies of a vector count once.
    Rows that lie on a drawn one come last, so a group with fewer than k different vectors has equal centres.
    """
    drawn: Centres = {}
    for i in range(k):
        u = (F.pmod(F.xxhash64("v", F.lit(seed), F.lit(i)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
        d = _least_distance(drawn) if drawn else F.lit(1.0)
        keyed = rows.select("grp", "v", d.alias("d")).withColumn(
            "at", F.when(F.col("d") > 0, -F.log(u) / F.col("d")).otherwise(F.lit(float("inf")))
        )
        least = keyed.groupBy("grp").agg(F.min(F.struct("at", "v")).alias("m")).select("grp", "m.v")
        for r in least.toLocalIterator():
            row = np.asarray(r["v"], dtype=np.float64)[None, :]
            drawn[r["grp"]] = np.concatenate([drawn[r["grp"]], row]) if r["grp"] in drawn else row
    wanted = set(groups)
    return {g: c for g, c in drawn.items() if g in wanted}


def kmeans_fit_by(
    df: DataFrame,
    group: str | None,
    k: int = 4,
    seed: int = 42,
    vector_col: str = "embedding",
    max_iter: int = 100,
) -> Centres:
    """Centres (k x length) of every group with more than k rows.

    The rows are stored once, dealt out, and read once per iteration for all groups that still move.
    """
    rows = dealt_out(materialize(_group_vectors(df, group, vector_col), "kmeans-rows"), _TASK_ROWS).persist()
    groups = [r["grp"] for r in count_by(rows, "grp").where(F.col("n") > k).orderBy("grp").toLocalIterator()]
    centres = seed_centres(rows, groups, k, seed) if groups else {}
    moving = dict(centres)
    for _ in range(max_iter):
        if not moving:
            break
        means, _ = lloyd_step(rows, moving)
        centres.update(means)
        moving = {g: c for g, c in means.items() if ((c - moving[g]) ** 2).sum(axis=1).max() > _TOLERANCE**2}
    rows.unpersist()
    return {g: centres[g] for g in groups}


def kmeans_assign(
    df: DataFrame,
    centres: Mapping[str, np.ndarray] | Sequence[Sequence[float]],
    vector_col: str = "embedding",
    group: str | None = None,
    out: str = "cluster",
) -> DataFrame:
    """Nearest centre of every row, all groups in one pass; null where the group has no centres."""
    if not isinstance(centres, Mapping):
        centres = {"": np.asarray(centres, dtype=np.float64)}
    return df.withColumn(out, nearest_centre(vector_col, centres, group))


def kmeans_by(
    df: DataFrame,
    group: str | None,
    k: int = 4,
    seed: int = 42,
    vector_col: str = "embedding",
    out: str = "cluster",
) -> DataFrame:
    """Fit inside each group and give every row its cluster."""
    centres = kmeans_fit_by(df, group, k, seed, vector_col)
    return kmeans_assign(df, centres, vector_col, group, out)


def cluster_sizes(assigned: DataFrame, *columns: str) -> DataFrame:
    """Rows per cluster in order of the cluster id."""
    columns = columns or ("cluster",)
    known = assigned.where(F.col(columns[-1]).isNotNull())
    return count_by(known, *columns).orderBy(*columns)
