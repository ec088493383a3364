"""Whole analyses put together from the operators. All take and return DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.sizing import materialize
from narrascope.functions.vectors import quadrant
from narrascope.operators import emotion, extremes, symbols, topics
from narrascope.operators.clusters import kmeans_assign, kmeans_fit_by
from narrascope.operators.pca import PcaModel, pca_fit, pca_fit_by, pca_transform
from narrascope.operators.sampling import sample_n
from narrascope.operators.stats import resolve_author_col, resolve_text_col


@dataclass(frozen=True)
class FactsAndSummary:
    facts: DataFrame
    summary: DataFrame


def symbol_report(
    reports: DataFrame,
    dictionary: DataFrame,
    key: str,
    text_col: str | None = None,
    author_col: str | None = None,
) -> FactsAndSummary:
    """Best symbol of every report and the summary per symbol."""
    text_col = text_col or resolve_text_col(reports)
    author_col = author_col or resolve_author_col(reports)
    index = symbols.SymbolIndex.build(dictionary)
    matched = symbols.symbol_match(reports, index, key, text_col)
    return FactsAndSummary(matched, symbols.symbol_summary(matched, index, author_col))


def topic_report(
    reports: DataFrame,
    text_col: str | None = None,
    author_col: str | None = None,
    **fit_options,
) -> tuple[FactsAndSummary, topics.TopicModel]:
    """Topics of a corpus, the topic of every report and the summary per topic."""
    text_col = text_col or resolve_text_col(reports)
    author_col = author_col or resolve_author_col(reports)
    model = topics.topics_fit(reports, text_col, **fit_options)
    keywords = model.keywords()
    assigned = model.assign(reports, text_col)
    facts = topics.join_keywords(
        assigned,
        keywords.select("topic_id", F.col("short_keywords").alias("topic_keywords")),
        bounded=True,
    )
    summary = topics.topic_summary(assigned, author_col, keywords=keywords)
    return FactsAndSummary(facts, summary), model


@dataclass(frozen=True)
class EmotionReport:
    scored: DataFrame
    facts: DataFrame
    distribution: DataFrame
    by_topic: DataFrame | None
    extremes: DataFrame


def emotion_report(
    reports: DataFrame,
    lexicon: DataFrame,
    key: str,
    text_col: str | None = None,
    neg: Sequence[str] = emotion.NIGHTMARE_KEYWORDS,
    pos: Sequence[str] = emotion.BLISS_KEYWORDS,
    store: bool = True,
) -> EmotionReport:
    """Scores, label distribution, emotion per topic (when topics are known) and extremes.

    The narrow score table feeds the summaries, so it is written once. `facts` scores the full reports
    where they are read, so their texts are never joined or shuffled.
    """
    text_col = text_col or resolve_text_col(reports)
    topic_cols = [c for c in ("topic_id", "topic_keywords") if c in reports.columns]
    scored = emotion.hybrid_score(reports, lexicon, key, text_col, neg, pos, keep=topic_cols)
    if store:
        scored = materialize(scored, "emotion")
    facts = emotion.emotion_facts(reports, lexicon, text_col, neg, pos)
    return EmotionReport(
        scored,
        facts,
        emotion.sentiment_distribution(scored),
        emotion.topic_emotion(scored, topic_cols) if "topic_id" in topic_cols else None,
        emotion.extreme_reports(scored, reports, key, text_col),
    )


@dataclass(frozen=True)
class SemanticMap:
    points: DataFrame
    model: PcaModel
    local_models: dict[str, PcaModel]


def semantic_map(
    vectors: DataFrame,
    key: str,
    vector_col: str = "embedding",
    k_clusters: int = 4,
    sample: int | None = None,
    seed: int = 42,
    min_rows: int = 10,
    store: bool = True,
) -> SemanticMap:
    """Global map, quadrants, local map and clusters inside each quadrant.

    Every step adds columns to the rows, so texts or authors kept in `vectors` stay with their
    coordinates. Vectors are computed before this step and never again.
    """
    if sample is not None:
        vectors = sample_n(vectors, sample, seed, key)
    model = pca_fit(vectors, 2, vector_col)
    points = pca_transform(vectors, model, ("pca1", "pca2"), vector_col)
    points = points.withColumn("quadrant", quadrant("pca1", "pca2"))
    if store:
        points = materialize(points, "semantic-map")
    local = pca_fit_by(points, "quadrant", 2, vector_col, min_rows)
    centres = kmeans_fit_by(points, "quadrant", k_clusters, seed, vector_col)
    points = pca_transform(points, local, ("q_pca1", "q_pca2"), vector_col, "quadrant")
    points = kmeans_assign(points, centres, vector_col, "quadrant")
    return SemanticMap(points, model, local)


def axis_export_report(
    vectors: DataFrame,
    key: str,
    text_col: str,
    model_name: str,
    vector_col: str = "embedding",
    n_axes: int = 5,
    k: int = extremes.PER_POLE,
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Sample, project on `n_axes` components, keep the extremes of each axis, nest them."""
    if sample is not None:
        vectors = sample_n(vectors, sample, seed, key)
    model = pca_fit(vectors, n_axes, vector_col)
    names = [f"pc{i + 1}" for i in range(n_axes)]
    coords = pca_transform(vectors, model, names, vector_col).withColumn("axes", F.array(*names))
    found = extremes.axis_extremes(coords, key, "axes", n_axes, k, vectors, text_col)
    return extremes.axis_export(found, key, model.ratio.tolist(), model.n, model_name)
