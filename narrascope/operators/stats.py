"""Column discovery, totals, percent of total, exact median, union by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.functions.sizing import materialize

# The names under which a report text is looked for first.
TEXT_COLUMN_NAMES = ("report", "content", "dream", "description")
# Fixed value: a missing text counts with the length of its printed form, `nan`.
MISSING_TEXT_LENGTH = 3

MEDIAN_COLLECT_ROWS = 100_000
MEDIAN_ACCURACY = 10_000


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def mean_text_length(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per string column with its mean length, in one pass over the data."""
    columns = list(columns or string_columns(df))
    means = df.agg(
        *[
            F.avg(F.coalesce(F.length(F.col(c)), F.lit(MISSING_TEXT_LENGTH))).alias(c)
            for c in columns
        ]
    )
    return means.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mean_length"))
                    for c in columns
                ]
            )
        )
    )


def resolve_text_col(df: DataFrame) -> str:
    """The report text column: a known name, else the string column with the longest mean length."""
    for name in TEXT_COLUMN_NAMES:
        if name in df.columns:
            return name
    columns = string_columns(df)
    if not columns:
        raise ValueError("no string column to take as text")
    if len(columns) == 1:
        return columns[0]
    means = {r["column_name"]: r["mean_length"] or 0.0 for r in mean_text_length(df).collect()}
    return max(columns, key=lambda c: means[c])


def resolve_author_col(df: DataFrame) -> str | None:
    """The author column is the third column, if there is one."""
    return df.columns[2] if len(df.columns) >= 3 else None


def drop_null_text(df: DataFrame, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull())


def with_percent(summary: DataFrame, count_col: str, out: str = "percent") -> DataFrame:
    """Percent of the total of `count_col`.

    `summary` is an aggregate (one row per label, topic or symbol). It is stored once; the total is a
    partial sum per task over the stored rows and becomes a constant.
    """
    summary = materialize(summary, "percent")
    total = summary.agg(F.sum(count_col)).first()[0]
    return summary.withColumn(out, F.try_divide(F.col(count_col) * F.lit(100.0), F.lit(total).cast("double")))


def count_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def source_counts(df: DataFrame, source_col: str) -> DataFrame:
    """Rows per source, and the total in a row of its own, marked by `is_total`: a source may be null.

    The rollup runs on the per-source counts, not on the rows.
    """
    per_source = count_by(df, source_col)
    return per_source.rollup(source_col).agg(F.sum("n").alias("n"), (F.grouping(source_col) == 1).alias("is_total"))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union matching columns by name; a column missing on one side is null there."""
    out = first
    for df in others:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def groups_with_min_size(df: DataFrame, group: str, min_rows: int) -> DataFrame:
    """Rows whose group has at least `min_rows` rows.

    The group sizes are pre-aggregated; the planner broadcasts them when they are small and
    otherwise shuffles, with adaptive splitting of a hot group.
    """
    big = count_by(df, group).where(F.col("n") >= min_rows).select(group)
    return df.join(big, group, "left_semi")


def exact_median(df: DataFrame, value: Column | str) -> float | None:
    """Exact median (mean of the two middle values) of any number of rows.

    Each pass brackets the middle ranks with `percentile_approx` and counts the rows below, on and
    between the two bounds, which are one-row aggregates. The open interval between the bounds holds
    about 4 / accuracy of the rows, so at most a few passes lead to a range small enough to sort on
    the driver. A value shared by many rows is recognised on a bound and never collected.
    """
    v = F.col(value) if isinstance(value, str) else value
    values = df.select(v.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if n == 0:
        return None
    pending = {(n - 1) // 2, n // 2}
    found: dict[int, float] = {}
    here, below, size, eps = values, 0, n, 2.0 / MEDIAN_ACCURACY
    while pending:
        if size <= MEDIAN_COLLECT_ROWS:
            ordered = sorted(r["v"] for r in here.collect())
            found.update({r: ordered[r - below] for r in pending})
            break
        p_lo = max(0.0, (min(pending) - below) / size - eps)
        p_hi = min(1.0, (max(pending) - below) / size + eps)
        lo, hi = here.agg(
            F.percentile_approx("v", F.array(F.lit(p_lo), F.lit(p_hi)), MEDIAN_ACCURACY)
        ).first()[0]
        c = here.agg(
            F.count_if(F.col("v") < lo).alias("under"),
            F.count_if(F.col("v") == lo).alias("at_lo"),
            F.count_if((F.col("v") > lo) & (F.col("v") < hi)).alias("inside"),
            F.count_if((F.col("v") == hi) & (F.lit(hi) > lo)).alias("at_hi"),
        ).first()
        first_inside = below + c["under"] + c["at_lo"]
        end_inside = first_inside + c["inside"]
        if min(pending) < below + c["under"] or max(pending) >= end_inside + c["at_hi"]:
            eps *= 2.0  # the bounds missed a rank: widen and repeat
            continue
        for r in list(pending):
            if r < first_inside:
                found[r] = lo
                pending.discard(r)
            elif r >= end_inside:
                found[r] = hi
                pending.discard(r)
        here = here.where((F.col("v") > lo) & (F.col("v") < hi))
        below, size = first_inside, c["inside"]
    return (found[(n - 1) // 2] + found[n // 2]) / 2.0


# The two sides of the binary split.
HIGH_LABEL = "High emotional / dramatic"
LOW_LABEL = "Everyday / mundane"


def median_split(df: DataFrame, value: str, out: str = "split_label") -> DataFrame:
    """Label rows at or above the exact median, and the rest; a null or NaN value has no label.

    The median is a literal in the plan.
    """
    threshold = exact_median(df, value)
    v = F.col(value).cast("double")
    label = F.when(v >= F.lit(threshold), HIGH_LABEL).otherwise(LOW_LABEL)
    return df.withColumn(out, F.when(v.isNotNull() & ~F.isnan(v), label))
