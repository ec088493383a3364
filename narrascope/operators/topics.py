"""Term statistics, vocabulary, topics, topic assignment and summary."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import as_list, dealt_out, materialize
from narrascope.operators.sampling import top_k_per_group
from narrascope.operators.stats import drop_null_text, with_percent

# Words left out in addition to the English stop words.
EXTRA_STOP_WORDS = (
    "dream", "dreamed", "dreamt", "woke", "awakened", "remember", "recall", "say", "says", "look",
    "said", "realized", "went", "got", "did", "like", "just", "know", "think", "saw", "felt",
    "didn", "thought", "don", "asked", "told", "started", "looking", "going", "looked", "wanted",
    "came", "couldn", "saying", "sent", "i",
)

MIN_DF, MAX_DF, MAX_TERMS = 10, 0.9, 1500
TOP_WORDS, SHORT_WORDS = 10, 3


def default_stop_words() -> list[str]:
    """Spark's English list, split like the texts are, and the extra words."""
    english = StopWordsRemover.loadDefaultStopWords("english")
    parts = {p for w in english for p in w.lower().replace("'", " ").split()}
    return sorted(parts | {w.lower() for w in english} | set(EXTRA_STOP_WORDS))


def _terms(text_col: str, mode: str, stop_words: Sequence[str]) -> Column:
    return tx.without(tx.tokens(text_col, mode), stop_words)


def bag_of_words(
    reports: DataFrame,
    key: str | Sequence[str],
    text_col: str,
    mode: str = "word",
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """(key, term, cnt), counted inside each row: no shuffle."""
    rows = drop_null_text(reports, text_col)
    counted = rows.select(*as_list(key), F.inline(tx.bag(_terms(text_col, mode, stop_words))))
    return counted.select(*as_list(key), "term", "cnt")


def term_stats(
    reports: DataFrame, text_col: str, mode: str = "word", stop_words: Sequence[str] = ()
) -> DataFrame:
    """(term, n_docs, n_total). Rows are pre-counted, so one shuffle of (term, two sums) is enough.

    Counting distinct reports per term would shuffle every (term, report) pair.
    """
    rows = drop_null_text(reports, text_col)
    return summed_terms(rows.select(F.inline(tx.bag(_terms(text_col, mode, stop_words)))))


def summed_terms(counted: DataFrame) -> DataFrame:
    """(term, n_docs, n_total) of (term, cnt), with one row per report and term."""
    return counted.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("cnt").alias("n_total")
    )


def vocabulary(
    reports: DataFrame,
    text_col: str,
    mode: str = "alpha3",
    stop_words: Sequence[str] = (),
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_terms: int = MAX_TERMS,
    n_docs: int | None = None,
) -> DataFrame:
    """The most frequent terms that occur in at least `min_df` reports and `max_df` of all."""
    rows = drop_null_text(reports, text_col)
    total = F.lit(n_docs) if n_docs is not None else rows.agg(F.count(F.lit(1))).scalar()
    return frequent_terms(term_stats(rows, text_col, mode, stop_words), total, min_df, max_df, max_terms)


def frequent_terms(
    stats: DataFrame, total: Column, min_df: int = MIN_DF, max_df: float = MAX_DF, max_terms: int = MAX_TERMS
) -> DataFrame:
    """The rows of `stats` that make the vocabulary of `total` reports."""
    return (
        stats.where((F.col("n_docs") >= min_df) & (F.col("n_docs") <= F.lit(float(max_df)) * total))
        .orderBy(F.desc("n_total"), "term")
        .limit(max_terms)
    )


def dominant_topic(weights: Column | str) -> Column:
    """1-based position of the first largest weight."""
    w = F.col(weights) if isinstance(weights, str) else weights
    return F.array_position(w, F.array_max(w)).cast("int")


def keyword_string(words: Column | str, k: int) -> Column:
    return F.array_join(F.slice(words, 1, k), ", ")


def topic_top_words(
    weights: DataFrame, topic: str = "topic_id", n: int = TOP_WORDS
) -> DataFrame:
    """(topic, term, weight, rank): the n heaviest terms of every topic of a long weight table."""
    order = [F.desc("weight"), F.asc("term")]
    return top_k_per_group(weights, [topic], order, n)


def topic_keywords(top_words: DataFrame, topic: str = "topic_id") -> DataFrame:
    """One row per topic with its keyword strings of ten and of three words."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return (
        top_words.groupBy(topic)
        .agg(F.transform(ranked, lambda r: r["term"]).alias("_w"))
        .select(
            topic,
            keyword_string("_w", TOP_WORDS).alias("keywords"),
            keyword_string("_w", SHORT_WORDS).alias("short_keywords"),
        )
    )


def join_keywords(
    df: DataFrame, keywords: DataFrame, topic: str = "topic_id", bounded: bool = False
) -> DataFrame:
    """Keyword strings onto reports or summaries; rows without keywords are kept.

    `bounded` says that `keywords` has one row per fitted topic and may be broadcast. Otherwise the
    planner decides; measuring the size here would run the keyword query twice.
    """
    return df.join(F.broadcast(keywords) if bounded else keywords, topic, "left")


def topic_summary(
    assigned: DataFrame,
    author_col: str | None,
    topic: str = "topic_id",
    keywords: DataFrame | None = None,
) -> DataFrame:
    """Reports, words, mean words, authors and percent per topic, largest topic first."""
    authors = F.countDistinct(author_col) if author_col else F.lit(0).cast("long")
    stats = (
        assigned.where(F.col(topic).isNotNull())
        .groupBy(topic)
        .agg(
            F.count(F.lit(1)).alias("dreams_count"),
            F.sum("word_count").alias("total_words"),
            F.avg("word_count").alias("avg_words"),
            authors.alias("dreamers_count"),
        )
    )
    stats = with_percent(stats, "dreams_count")
    if keywords is not None:
        stats = join_keywords(stats, keywords, topic)
    return stats.orderBy(F.desc("dreams_count"), topic)


@dataclass(frozen=True)
class TopicModel:
    lda: LDAModel
    terms: tuple[str, ...]
    counter: CountVectorizerModel
    mode: str
    stop_words: tuple[str, ...]

    def features(self, reports: DataFrame, text_col: str) -> DataFrame:
        """Sparse counts over the vocabulary; a row-local step."""
        rows = drop_null_text(reports, text_col)
        words = rows.withColumn("_words", _terms(text_col, self.mode, self.stop_words))
        return self.counter.transform(words).drop("_words")

    def top_words(self, n: int = TOP_WORDS) -> DataFrame:
        """(topic_id, term, weight, rank) of the fitted topics."""
        described = self.lda.describeTopics(n)
        vocabulary_array = F.array(*[F.lit(t) for t in self.terms])
        pairs = F.arrays_zip(F.col("termIndices").alias("i"), F.col("termWeights").alias("w"))
        return described.select(
            (F.col("topic") + 1).alias("topic_id"), F.posexplode(pairs).alias("pos", "p")
        ).select(
            "topic_id",
            F.get(vocabulary_array, F.col("p")["i"]).alias("term"),
            F.col("p")["w"].alias("weight"),
            (F.col("pos") + 1).alias("rank"),
        )

    def keywords(self) -> DataFrame:
        return topic_keywords(self.top_words())

    def assign(self, reports: DataFrame, text_col: str) -> DataFrame:
        """All columns of `reports` with `word_count`, `topic_weights` and `topic_id`; no shuffle."""
        scored = self.lda.transform(self.features(reports, text_col))
        return (
            scored.withColumn("topic_weights", vector_to_array("topicDistribution"))
            .withColumn("word_count", tx.word_count(text_col))
            .withColumn("topic_id", dominant_topic("topic_weights"))
            .drop("features", "topicDistribution")
        )


def topics_fit(
    reports: DataFrame,
    text_col: str,
    k: int = 100,
    seed: int = 42,
    max_iter: int = 10,
    mode: str = "alpha3",
    stop_words: Sequence[str] | None = None,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_terms: int = MAX_TERMS,
    sampling_rate: float = 1.0,
) -> TopicModel:
    """Learn the vocabulary and fit the topics on every report.

    The corpus is passed `max_iter` times. With a `sampling_rate` below one an iteration sees that
    share of it, and there are as many more iterations, so the number of passes stays the same at any
    size. Features are written once, dealt out, and read by every iteration. Only the vocabulary (at most
    `max_terms` words) and the topic matrix reach the driver.
    """
    stop = tuple(default_stop_words() if stop_words is None else stop_words)
    rows = drop_null_text(reports, text_col)
    n = rows.count()
    vocab = vocabulary(rows, text_col, mode, stop, min_df, max_df, max_terms, n_docs=n)
    terms = tuple(sorted(r["term"] for r in vocab.select("term").collect()))
    if not terms:
        raise ValueError("no term passes the frequency bounds")
    counter = CountVectorizerModel.from_vocabulary(
        list(terms), inputCol="_words", outputCol="features"
    )
    model = TopicModel(None, terms, counter, mode, stop)
    features = model.features(rows.select(text_col), text_col).select("features")
    # Stored, so that a lost executor costs a re-read; dealt out, so that every iteration uses all tasks.
    features = dealt_out(materialize(features, "topic-features")).persist()
    lda = LDA(
        k=k,
        seed=seed,
        maxIter=math.ceil(max_iter / sampling_rate),
        optimizer="online",
        subsamplingRate=sampling_rate,
        learningOffset=10.0,
        learningDecay=0.7,
        optimizeDocConcentration=False,
        featuresCol="features",
    ).fit(features)
    features.unpersist()
    return TopicModel(lda, terms, counter, mode, stop)
