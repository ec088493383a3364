"""Reports at both ends of every axis, their nested export, and odd-one-out rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import small_table
from narrascope.operators.sampling import seeded_hash, top_k_per_group

POSITIVE, NEGATIVE = "positive", "negative"
PER_POLE = 20
TEXT_LIMIT = 600
MAJORITY = 3


def axis_extremes(
    coords: DataFrame,
    key: str,
    axes_col: str,
    n_axes: int,
    k: int = PER_POLE,
    reports: DataFrame | None = None,
    text_col: str | None = None,
) -> DataFrame:
    """(axis_id, pole, rank, key, score[, text]): the k highest and k lowest rows of every axis.

    Only (axis, pole, score, key) is ranked. Texts are joined afterwards to the at most
    2 * k * n_axes rows that are left.
    """
    axes = F.slice(F.col(axes_col), 1, n_axes).cast("array<double>")
    poles = F.array(
        F.struct(F.lit(POSITIVE).alias("pole"), F.lit(1.0).alias("sign")),
        F.struct(F.lit(NEGATIVE).alias("pole"), F.lit(-1.0).alias("sign")),
    )
    scores = (
        coords.select(key, F.posexplode(axes).alias("pos", "raw"))
        .where(F.col("raw").isNotNull() & ~F.isnan("raw"))
        .select(key, (F.col("pos") + 1).alias("axis_id"), "raw", F.inline(poles))
    )
    best = top_k_per_group(
        scores,
        ["axis_id", "pole"],
        [F.desc(F.col("raw") * F.col("sign")), F.asc(key)],
        k,
    ).select("axis_id", "pole", "rank", key, F.round("raw", 4).alias("score"))
    if reports is None:
        return best
    texts = reports.select(key, F.col(text_col).alias("text"))
    return (
        texts.join(F.broadcast(best), key)
        .withColumn("text", tx.ellipsize("text", TEXT_LIMIT))
        .select("axis_id", "pole", "rank", key, "score", "text")
    )


def axis_export(
    extremes: DataFrame,
    key: str,
    ratios: Sequence[float],
    n_sampled: int,
    model: str,
    descriptions: dict[tuple[int, str], str] | None = None,
) -> DataFrame:
    """One row: metadata and the array of axes, each with its two poles."""
    spark = extremes.sparkSession
    descriptions = descriptions or {}
    entry = F.struct(
        "rank", F.struct(F.col(key).alias("id"), "text", "score").alias("dream")
    )

    def pole(name: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("pole") == name, entry)))
        return F.transform(rows, lambda r: r["dream"])

    info = small_table(
        spark,
        [
            (
                i + 1,
                f"PC{i + 1}",
                float(r),
                descriptions.get((i + 1, POSITIVE), ""),
                descriptions.get((i + 1, NEGATIVE), ""),
            )
            for i, r in enumerate(ratios)
        ],
        "axis_id int, label string, explained_var double, pos_text string, neg_text string",
    ).withColumn("explained_var", F.round("explained_var", 4))
    axes = (
        extremes.groupBy("axis_id")
        .agg(pole(POSITIVE).alias("pos"), pole(NEGATIVE).alias("neg"))
        .join(F.broadcast(info), "axis_id")
        .select(
            F.struct(
                "axis_id",
                "label",
                "explained_var",
                F.struct(F.col("pos_text").alias("description"), F.col("pos").alias("dreams")).alias(
                    "positive_pole"
                ),
                F.struct(F.col("neg_text").alias("description"), F.col("neg").alias("dreams")).alias(
                    "negative_pole"
                ),
            ).alias("axis")
        )
    )
    metadata = F.struct(
        F.lit(n_sampled).cast("long").alias("n_dreams_sampled"),
        F.lit(len(ratios)).alias("n_components"),
        F.array(*[F.round(F.lit(float(r)), 4) for r in ratios]).alias("explained_variance"),
        F.lit(model).alias("model"),
    )
    return axes.agg(F.array_sort(F.collect_list("axis")).alias("axes")).select(
        metadata.alias("metadata"), "axes"
    )


def make_rounds(extremes: DataFrame, key: str, n_rounds: int = 1, seed: int = 42) -> DataFrame:
    """Rounds of four texts per axis: three from the shown pole and one intruder from the other.

    Which pole is shown, which rows take part and their order follow from hashes of the seed, so the
    same input gives the same rounds on any cluster. The input has at most k rows per axis and pole.
    """
    shown = F.when(
        F.substring(seeded_hash(seed, "axis_id", "round"), 1, 1) < "8", F.lit(POSITIVE)
    ).otherwise(F.lit(NEGATIVE))
    members = (
        extremes.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(n_rounds))))
        .withColumn("shown", shown)
        .withColumn("pick", seeded_hash(seed, F.lit("pick"), "axis_id", "round", key))
        .withColumn("place", seeded_hash(seed, F.lit("place"), "axis_id", "round", key))
        .withColumn("intruder", F.col("pole") != F.col("shown"))
    )
    order = Window.partitionBy("axis_id", "round", "pole").orderBy("pick", key)
    chosen = members.withColumn("r", F.row_number().over(order)).where(
        F.col("r") <= F.when(F.col("intruder"), 1).otherwise(MAJORITY)
    )
    cards = F.array_sort(
        F.collect_list(F.struct("place", F.col(key).alias("id"), "intruder", "text"))
    )
    return (
        chosen.groupBy("axis_id", "round", "shown")
        .agg(cards.alias("cards"))
        .where(F.size("cards") == MAJORITY + 1)
        .select(
            "axis_id",
            "round",
            "shown",
            F.array_position(F.transform("cards", lambda c: c["intruder"]), True)
            .cast("int")
            .alias("correct"),
            F.transform("cards", lambda c: c["id"]).alias("ids"),
            F.transform("cards", lambda c: c["text"]).alias("texts"),
        )
    )
