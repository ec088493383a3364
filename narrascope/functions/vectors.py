"""Row-local vector expressions: clean-up, projection on given axes, nearest centre, quadrants."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import small_table

# Fixed value: the largest finite 32-bit float, which replaces infinite entries.
FLOAT32_MAX = 3.4028234663852886e38

# Display name and colour of the four quadrants (x > 0, y > 0; and so on).
QUADRANTS = (
    ("Dramatic + Experiential", "crimson"),
    ("Everyday + Experiential", "orange"),
    ("Dramatic + Cognitive", "royalblue"),
    ("Everyday + Cognitive", "seagreen"),
)


def clean_vector(vector: Column | str) -> Column:
    """NaN becomes 0 and infinities the largest finite 32-bit float; entries become doubles."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(
        v.cast("array<double>"),
        lambda x: F.when(F.isnan(x), 0.0)
        .when(x == float("inf"), FLOAT32_MAX)
        .when(x == float("-inf"), -FLOAT32_MAX)
        .otherwise(x),
    )


def quadrant(x: Column | str, y: Column | str) -> Column:
    """Quadrant name of a point; none when a coordinate is null or NaN."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    names = [name for name, _ in QUADRANTS]
    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return (
        F.when(~known, None)
        .when((x > 0) & (y > 0), names[0])
        .when((x <= 0) & (y > 0), names[1])
        .when((x > 0) & (y <= 0), names[2])
        .otherwise(names[3])
    )


def quadrant_dim(spark: SparkSession) -> DataFrame:
    """The four quadrants with folder name, title and colour."""
    dim = small_table(spark, QUADRANTS, "quadrant string, colour string")
    return dim.select(
        tx.slug("quadrant").alias("quadrant_slug"), F.col("quadrant").alias("title"), "colour"
    )


def with_quadrant_style(df: DataFrame, slug_col: str = "quadrant_slug") -> DataFrame:
    """Title and colour of each row's quadrant: a join with a table of four rows."""
    dim = quadrant_dim(df.sparkSession).withColumnRenamed("quadrant_slug", slug_col)
    return df.join(F.broadcast(dim), slug_col, "left")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a null-free list column as a float64 matrix, with NaN and infinities replaced."""
    values = np.asarray(column.flatten(), dtype=np.float64)
    if len(column) == 0:
        return values.reshape(0, 0)
    if values.size % len(column):
        raise ValueError("vectors of different lengths")
    width = values.size // len(column)
    lengths = np.diff(np.asarray(column.offsets))
    if not (lengths == width).all():
        raise ValueError("vectors of different lengths")
    values = values.reshape(len(column), width)
    if np.isfinite(values).all():
        return values
    return np.nan_to_num(values, nan=0.0, posinf=FLOAT32_MAX, neginf=-FLOAT32_MAX)


def group_rows(groups: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """(name, row numbers) of every group in a column; one sort, whatever the number of groups."""
    encoded = groups.dictionary_encode()
    codes = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    for name, start, end in zip(encoded.dictionary.to_pylist(), bounds, bounds[1:]):
        yield name, order[start:end]


def _by_group(
    vectors: pa.Array, groups: pa.Array, width: int, known: Mapping[str, object], fn
) -> pa.Array:
    """Apply `fn(rows, known[group])` to the rows of each known group; other rows give null."""
    out = np.zeros((len(vectors), width))
    valid = np.zeros(len(vectors), dtype=bool)
    usable = np.asarray(vectors.is_valid())
    for name, rows in group_rows(groups):
        rows = rows[usable[rows]]
        if name in known and rows.size:
            out[rows] = fn(matrix(vectors.take(pa.array(rows))), known[name])
            valid[rows] = True
    offsets = pa.array(np.append(np.arange(len(vectors)) * width, len(vectors) * width).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(~valid))


def project(
    vector: Column | str,
    axes: Mapping[str, np.ndarray],
    means: Mapping[str, np.ndarray],
    group: Column | str | None = None,
) -> Column:
    """(vector - mean) . axes as `array<double>`, one matrix product per Arrow batch.

    `axes[g]` is a (length x k) matrix. Without a group the single entry "" is used. Lambda
    expressions over the array give the same numbers but evaluate every product interpretively.
    The function is declared non-deterministic only to keep the optimizer from copying it into
    inferred filters, which would evaluate it twice.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    g = F.lit("") if group is None else (F.col(group) if isinstance(group, str) else group)
    models = {name: (np.asarray(axes[name]), np.asarray(means[name])) for name in axes}
    width = max((a.shape[1] for a, _ in models.values()), default=0)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array, groups: pa.Array) -> pa.Array:
        return _by_group(
            vectors, groups, width, models, lambda rows, m: (rows - m[1]) @ m[0]
        )

    return run.asNondeterministic()(v, g.cast("string"))


def nearest_centre(
    vector: Column | str, centres: Mapping[str, np.ndarray], group: Column | str | None = None
) -> Column:
    """Index of the nearest centre by squared distance; the lowest index among equals."""
    v = F.col(vector) if isinstance(vector, str) else vector
    g = F.lit("") if group is None else (F.col(group) if isinstance(group, str) else group)
    models = {name: np.asarray(c, dtype=np.float64) for name, c in centres.items()}

    def assign(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        distance = np.stack([((rows - centre) ** 2).sum(axis=1) for centre in c], axis=1)
        return distance.argmin(axis=1).reshape(-1, 1)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array, groups: pa.Array) -> pa.Array:
        return _by_group(vectors, groups, 1, models, assign)

    return F.get(run.asNondeterministic()(v, g.cast("string")), F.lit(0)).cast("int")
