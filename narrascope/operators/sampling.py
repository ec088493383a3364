"""Repeatable sampling and ranking inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEX_PER_PASS = 3
_COLLECT_ROWS = 10_000
SALTS = 64


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """A hash order that depends on the seed and the keys, not on partitions or row order."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _hash_cutoff(hashes: DataFrame, n: int) -> str | None:
    """The n-th smallest value of column `h`, or None when there are at most n rows.

    Counts rows by the next three hex digits (at most 4,096 groups) and descends into the group that
    holds the n-th row; a group of at most 10,000 hashes is read directly.
    """
    prefix, need = "", n
    while True:
        digits = F.substring("h", len(prefix) + 1, _HEX_PER_PASS)
        groups = (
            hashes.where(F.col("h").startswith(prefix))
            .groupBy(digits.alias("d"))
            .agg(F.count(F.lit(1)).alias("c"))
            .collect()
        )
        if not prefix and sum(g["c"] for g in groups) <= n:
            return None
        for g in sorted(groups, key=lambda g: g["d"]):
            if need <= g["c"]:
                prefix += g["d"]
                break
            need -= g["c"]
        if g["c"] <= _COLLECT_ROWS or len(prefix) >= 32:
            rest = hashes.where(F.col("h").startswith(prefix)).select("h")
            if len(prefix) >= 32:
                return prefix
            return sorted(r["h"] for r in rest.collect())[need - 1]


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly min(n, count) rows without replacement; `key` must be unique.

    The rows with the n smallest hashes are kept by one filter, so the sampled rows are neither
    shuffled nor sorted, whatever n is.
    """
    if n <= 0:
        return df.limit(0)
    h = seeded_hash(seed, key)
    cutoff = _hash_cutoff(df.select(h.alias("h")), n)
    return df if cutoff is None else df.where(h <= F.lit(cutoff))


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first k rows of every group, with their rank.

    Every task cuts to k rows per group before the shuffle. The rows that are left of a group are
    ranked in two rounds, first by (group, salt) and then by group, so that even with very many
    tasks no reducer gets all of them. The salt is taken from the task, which keeps the number of
    shuffled rows at k per group and task, and does not affect the result.
    """
    salt = F.spark_partition_id() % F.lit(salts)
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(inner))
        .where(F.col(rank) <= k)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= k)
    )
