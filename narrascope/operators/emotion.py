"""Emotion score of a report: lexicon base, keyword adjustment, label, and its summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import MAX_BROADCAST_ROWS, as_list, short_batches, small_table
from narrascope.operators.rules import ruled_sum
from narrascope.operators.stats import drop_null_text, with_percent

# Keywords that lower the score.
NIGHTMARE_KEYWORDS = (
    "nightmare", "terrified", "scared", "scream", "screaming", "blood", "kill", "death", "dead",
    "monster", "demon", "ghost", "chased", "running away", "trapped", "paralyzed", "darkness",
    "evil", "attack", "attacked", "gun", "knife", "corpse", "drowning", "falling", "teeth",
    "spider", "snake",
)
# Keywords that raise the score.
BLISS_KEYWORDS = (
    "happy", "joy", "love", "loved", "beautiful", "amazing", "wonderful", "peace", "peaceful",
    "flying", "fly", "lucid", "control", "kiss", "hug", "warmth", "light", "angel", "ecstasy",
    "perfect", "paradise",
)
# Weight of one keyword, and the labels.
KEYWORD_WEIGHT = 0.15
BLISSFUL = "🌟 Blissful / Happy"
POSITIVE = "🙂 Positive"
NEUTRAL = "😐 Neutral"
NEGATIVE = "😟 Negative"
NIGHTMARE = "💀 Nightmare / Scary"
LABEL_ORDER = (BLISSFUL, POSITIVE, NEUTRAL, NEGATIVE, NIGHTMARE)
# Mood icons of a mean score, and the percent one bar block stands for.
MOOD_LOW, MOOD_HIGH, MOOD_MID = "😱", "😍", "😐"
BAR_BLOCK, BAR_PERCENT = "█", 5
# Fixed value: constant of the published score normalisation s / sqrt(s * s + 15).
NORMALISER = 15.0


def keyword_count(text: Column | str, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur as substrings; each counts once, overlapping ones all count."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    total = F.lit(0)
    for word in keywords:
        total = total + F.contains(lowered, F.lit(word)).cast("int")
    return total


def sentiment_label(score: Column | str) -> Column:
    """Five classes, tested in this order; a null or NaN score has no label."""
    s = F.col(score) if isinstance(score, str) else score
    # The thresholds.
    return (
        F.when(s.isNull() | F.isnan(s), F.lit(None))
        .when(s >= 0.3, BLISSFUL)
        .when(s >= 0.05, POSITIVE)
        .when(s <= -0.4, NIGHTMARE)
        .when(s <= -0.05, NEGATIVE)
        .otherwise(NEUTRAL)
    )


def hybrid(base: Column, neg_hits: Column, pos_hits: Column) -> Column:
    """Base score moved by the keyword hits and clamped to [-1, 1]."""
    moved = base + (pos_hits * F.lit(KEYWORD_WEIGHT) - neg_hits * F.lit(KEYWORD_WEIGHT))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), moved))


def keyword_hits(
    reports: DataFrame,
    key: str | Sequence[str],
    text_col: str,
    neg: Sequence[str] = NIGHTMARE_KEYWORDS,
    pos: Sequence[str] = BLISS_KEYWORDS,
) -> DataFrame:
    return drop_null_text(reports, text_col).select(
        *as_list(key),
        keyword_count(text_col, neg).alias("neg_hits"),
        keyword_count(text_col, pos).alias("pos_hits"),
    )


def _valence_of(lexicon: DataFrame) -> tuple[list[str], list[float]]:
    """The lexicon by lower-cased word; several entries of a word count with their mean.

    A lexicon is a list of words that people have rated, so it is held by every task. Its size is
    checked; a table beyond the bound is no lexicon and is refused.
    """
    valence = lexicon.where("word is not null and valence is not null").groupBy(F.lower("word").alias("w"))
    rows = valence.agg(F.avg(F.col("valence").cast("double")).alias("v")).limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) > MAX_BROADCAST_ROWS:
        raise ValueError(f"a lexicon may have {MAX_BROADCAST_ROWS} words")
    return [r["w"] for r in rows], [r["v"] for r in rows]


def valence_sum(words: Column, lexicon: DataFrame) -> Column:
    """Sum of the valences of an array of tokens, looked up batch by batch: no shuffle, no explode."""
    known, values = _valence_of(lexicon)

    @F.arrow_udf("double")
    def total(tokens: pa.Array) -> pa.Array:
        at = pc.index_in(tokens.flatten(), pa.array(known, pa.string()))
        found = pc.fill_null(pc.take(pa.array(values, pa.float64()), at), 0.0).to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0.0], np.cumsum(found)])
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        return pa.array(sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else [], pa.float64())

    return F.round(total(words), 6)


def _base_sum(text_col: str, lexicon: DataFrame, rules: DataFrame | None) -> Column:
    short_batches(lexicon.sparkSession)
    if rules is None:
        return valence_sum(tx.tokens(text_col), lexicon)
    return ruled_sum(text_col, *_valence_of(lexicon), rules)


def _normalised(total: Column) -> Column:
    return total / F.sqrt(total * total + F.lit(NORMALISER))


def lexicon_score(
    reports: DataFrame,
    lexicon: DataFrame,
    key: str | Sequence[str],
    text_col: str,
    keep: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> DataFrame:
    """Base score in (-1, 1) from a (word, valence) table; a report without known words scores 0.

    With a (word, kind, step) table of `rules`, the words around count too; see `ruled_sum`.
    """
    rows = drop_null_text(reports, text_col)
    sums = rows.select(*as_list(key), *keep, _base_sum(text_col, lexicon, rules).alias("valence_sum"))
    return sums.withColumn("base_score", _normalised(F.col("valence_sum")))


def _with_scores(
    reports: DataFrame,
    lexicon: DataFrame,
    text_col: str,
    neg: Sequence[str],
    pos: Sequence[str],
    rules: DataFrame | None = None,
) -> DataFrame:
    """All columns with hits, scores and label, row by row."""
    scored = drop_null_text(reports, text_col).withColumns(
        {
            "neg_hits": keyword_count(text_col, neg),
            "pos_hits": keyword_count(text_col, pos),
            "valence_sum": _base_sum(text_col, lexicon, rules),
        }
    )
    scored = scored.withColumn("base_score", _normalised(F.col("valence_sum")))
    scored = scored.withColumn("sentiment_score", hybrid(F.col("base_score"), F.col("neg_hits"), F.col("pos_hits")))
    return scored.withColumn("sentiment_label", sentiment_label("sentiment_score"))


def hybrid_score(
    reports: DataFrame,
    lexicon: DataFrame,
    key: str | Sequence[str],
    text_col: str,
    neg: Sequence[str] = NIGHTMARE_KEYWORDS,
    pos: Sequence[str] = BLISS_KEYWORDS,
    keep: Sequence[str] = (),
    rules: DataFrame | None = None,
) -> DataFrame:
    """(key, keep..., base_score, hits, sentiment_score, sentiment_label), row by row without a shuffle."""
    scored = _with_scores(reports, lexicon, text_col, neg, pos, rules)
    names = ("neg_hits", "pos_hits", "valence_sum", "base_score", "sentiment_score", "sentiment_label")
    return scored.select(*as_list(key), *keep, *names)


def emotion_facts(
    reports: DataFrame,
    lexicon: DataFrame,
    text_col: str,
    neg: Sequence[str] = NIGHTMARE_KEYWORDS,
    pos: Sequence[str] = BLISS_KEYWORDS,
) -> DataFrame:
    """All columns of `reports` with score and label, row by row; no key is needed."""
    scored = _with_scores(reports, lexicon, text_col, neg, pos)
    return scored.drop("neg_hits", "pos_hits", "valence_sum", "base_score")


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """Count, percent and bar of every label in fixed order, labels without reports included."""
    spark = scored.sparkSession
    labels = small_table(
        spark, list(enumerate(LABEL_ORDER, 1)), "label_order int, sentiment_label string"
    )
    counts = scored.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))
    full = labels.join(counts, "sentiment_label", "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )
    full = with_percent(full, "n").withColumn("percent", F.coalesce("percent", F.lit(0.0)))
    blocks = F.floor(F.col("percent") / BAR_PERCENT).cast("int")
    return full.withColumn("bar", F.repeat(F.lit(BAR_BLOCK), blocks)).orderBy("label_order")


def mood_icon(mean_score: Column | str) -> Column:
    m = F.col(mean_score) if isinstance(mean_score, str) else mean_score
    return F.when(m < -0.2, MOOD_LOW).when(m > 0.2, MOOD_HIGH).otherwise(MOOD_MID)


def topic_emotion(scored: DataFrame, topic_cols: Sequence[str] = ("topic_id",)) -> DataFrame:
    """Reports, mean score and extreme labels per topic, from the scariest to the happiest."""
    known = scored
    for c in topic_cols:
        known = known.where(F.col(c).isNotNull())
    return (
        known.groupBy(*topic_cols)
        .agg(
            F.count("sentiment_score").alias("total_dreams"),
            F.avg("sentiment_score").alias("avg_sentiment"),
            F.count_if(F.col("sentiment_label") == NIGHTMARE).alias("nightmare_count"),
            F.count_if(F.col("sentiment_label") == BLISSFUL).alias("bliss_count"),
        )
        .withColumn("mood", mood_icon("avg_sentiment"))
        .orderBy("avg_sentiment", *topic_cols)
    )


def extreme_reports(scored: DataFrame, reports: DataFrame, key: str, text_col: str) -> DataFrame:
    """The happiest and the scariest report; among equal scores the lowest key.

    The two keys come from one narrow aggregate; the join for their texts sees two rows.
    """
    ends = scored.agg(
        F.min(F.struct((-F.col("sentiment_score")).alias("s"), F.col(key).alias("k"))).alias("top"),
        F.min(F.struct(F.col("sentiment_score").alias("s"), F.col(key).alias("k"))).alias("low"),
    )
    two = ends.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("happiest").alias("kind"),
                    F.col("top.k").alias(key),
                    (-F.col("top.s")).alias("sentiment_score"),
                ),
                F.struct(
                    F.lit("scariest").alias("kind"),
                    F.col("low.k").alias(key),
                    F.col("low.s").alias("sentiment_score"),
                ),
            )
        )
    )
    return reports.select(key, text_col).join(F.broadcast(two), key).select(
        "kind", key, "sentiment_score", tx.snippet(text_col, 300).alias("snippet")
    )
