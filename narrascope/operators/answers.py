"""Grading of odd-one-out answers and accuracy summaries.

Input of the summaries: one row per answer with `responder`, `axis`, `condition` and `is_correct`.
All aggregates combine before the shuffle, so a responder with a third of all answers is no burden.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WITH_LABELS, NO_LABELS = "with_labels", "no_labels"
OVERALL = "overall"


def grade(
    answers: DataFrame, rounds: DataFrame, on: str | Sequence[str] = "round_id"
) -> DataFrame:
    """Answers with the correct index of their round and whether they meet it.

    The planner broadcasts the rounds when they are small and shuffles otherwise.
    """
    on = [on] if isinstance(on, str) else list(on)
    return answers.join(rounds.select(*on, "correct"), on).withColumn(
        "is_correct", F.col("answer") == F.col("correct")
    )


def percent_correct() -> Column:
    return F.avg(F.col("is_correct").cast("double")) * 100.0


def model_band(score: Column | str) -> Column:
    """Colour band of an accuracy in percent."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 80, "high").when(s >= 60, "middle").otherwise("low")


def responder_band(score: Column | str) -> Column:
    """Message band of a responder's score in percent."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s == 100, "perfect").otherwise(model_band(s))


def _per_axis(graded: DataFrame) -> DataFrame:
    """Sums per responder, condition and axis: the only step that sees single answers."""
    return graded.groupBy("responder", "condition", "axis").agg(
        F.count_if("is_correct").alias("n_correct"), F.count("is_correct").alias("n_answers")
    )


def accuracy(graded: DataFrame) -> DataFrame:
    """Percent correct by responder, condition and axis, and overall, with its band."""
    pct = F.try_divide(F.sum("n_correct") * 100.0, F.sum("n_answers"))
    return (
        _per_axis(graded)
        .groupingSets(
            [("responder", "condition", "axis"), ("responder", "condition")],
            "responder",
            "condition",
            "axis",
        )
        .agg(
            F.sum("n_answers").alias("n_answers"),
            pct.alias("accuracy"),
            F.grouping("axis").alias("_all"),
        )
        .withColumn("axis", F.when(F.col("_all") == 1, F.lit(OVERALL)).otherwise(F.col("axis")))
        .drop("_all")
        .withColumn("band", model_band("accuracy"))
    )


def accuracy_pivot(graded: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row per responder and condition with a column per axis and `overall`."""
    return (
        accuracy(graded)
        .groupBy("responder", "condition")
        .pivot("axis", [*axes, OVERALL])
        .agg(F.first("accuracy"))
    )


def label_boost(graded: DataFrame) -> DataFrame:
    """Overall accuracy with labels minus without, in points with one decimal."""

    def pct(condition: str) -> Column:
        return F.avg(
            F.when(F.col("condition") == condition, F.col("is_correct").cast("double"))
        ) * 100.0

    return (
        graded.groupBy("responder")
        .agg(pct(WITH_LABELS).alias("with_labels"), pct(NO_LABELS).alias("no_labels"))
        .withColumn("boost", F.round(F.col("with_labels") - F.col("no_labels"), 1))
    )


def published_accuracy(
    published: DataFrame, responder: str = "responder", kind: str = "responder_type", nested: str = "results"
) -> DataFrame:
    """(responder, type, condition, axis, percent) from percents published as map(condition -> map(axis -> percent))."""
    by_condition = published.select(responder, kind, F.explode(nested).alias("condition", "_axes"))
    return by_condition.select(responder, kind, "condition", F.explode("_axes").alias("axis", "percent"))


def vs_human(graded: DataFrame, human: str, condition: str | None = None) -> DataFrame:
    """Accuracy of every other responder against the human one of the same condition and axis, in whole points.

    All conditions, or one. Without a human answer on an axis the comparison is null.
    """
    chosen = graded if condition is None else graded.where(F.col("condition") == condition)
    per_axis = chosen.groupBy("responder", "condition", "axis").agg(percent_correct().alias("accuracy"))
    people = per_axis.where(F.col("responder") == human).select(
        "condition", "axis", F.col("accuracy").alias("human_accuracy")
    )
    return (
        per_axis.where(F.col("responder") != human)
        .join(people, ["condition", "axis"], "left")
        .withColumn("diff", F.round(F.col("accuracy") - F.col("human_accuracy"), 0))
        .withColumn("beats_human", F.col("diff") > 0)
    )


def panel_accuracy(graded: DataFrame, round_cols: Sequence[str] = ("round_id",)) -> DataFrame:
    """Mean over rounds of the share of correct answers, as a rounded percent."""
    per_round = graded.groupBy(*round_cols).agg(
        F.avg(F.col("is_correct").cast("double")).alias("share"),
        F.count(F.lit(1)).alias("n"),
    )
    return per_round.agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.sum("n").alias("n_answers"),
        F.round(F.avg("share") * 100.0, 0).alias("panel_percent"),
    )


def responder_scores(graded: DataFrame, by: Sequence[str] = ("responder",)) -> DataFrame:
    """Correct answers, rounded percent and band of every responder."""
    return (
        graded.groupBy(*by)
        .agg(
            F.count_if("is_correct").alias("score"),
            F.count(F.lit(1)).alias("n_answers"),
            F.round(percent_correct(), 0).alias("percent"),
        )
        .withColumn("band", responder_band("percent"))
    )
