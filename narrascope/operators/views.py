"""Tables behind the plots: binned maps, labelled samples, annotated points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.operators.sampling import seeded_hash, top_k_per_group


def _finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def scatter_bins(df: DataFrame, x: str, y: str, bins: int, label: str) -> DataFrame:
    """(bin_x, bin_y, label, n): counts on a bins x bins grid over the range of the points.

    The range is read first, as one row; the counts combine before the shuffle.
    """
    points = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), label).where(_finite("_x", "_y"))
    x0, x1, y0, y1 = points.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()

    def bin_of(v: str, low: float | None, high: float | None) -> Column:
        if low is None or low == high:
            return F.lit(0)
        pos = F.floor((F.col(v) - F.lit(low)) / F.lit(high - low) * bins).cast("int")
        return F.least(pos, F.lit(bins - 1))

    return (
        points.select(
            bin_of("_x", x0, x1).alias("bin_x"), bin_of("_y", y0, y1).alias("bin_y"), label
        )
        .groupBy("bin_x", "bin_y", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_sample(df: DataFrame, label: str, n: int, seed: int, key: str) -> DataFrame:
    """A repeatable sample of at most n rows per label, with `rank`."""
    hashed = df.where(F.col(label).isNotNull()).withColumn("_h", seeded_hash(seed, key))
    order = [F.asc("_h"), F.asc(key)]
    return top_k_per_group(hashed, [label], order, n).drop("_h")


def annotated_points(
    df: DataFrame, key: str, x: str, y: str, text_col: str, n: int = 50, step: int = 5
) -> DataFrame:
    """Every `step`-th of the first n points with a 20-character label."""
    points = df.select(key, x, y, tx.snippet(text_col, 20).alias("annotation"))
    first = points.orderBy(key).limit(n)
    pos = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key))
    return first.withColumn("_pos", pos).where((F.col("_pos") - 1) % step == 0).drop("_pos")
