"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.catalog import params as P
from narrascope.functions import text as tx
from narrascope.functions import vectors as vx
from narrascope.functions.sizing import materialize, scratch_path, small_table
from narrascope.operators import answers as an
from narrascope.operators import clusters, emotion, extremes, pca, stats, symbols, topics, variational, views
from narrascope.operators.embedding import embed, feature_hash_embed
from narrascope.operators.keywords import keyword_counts, keyword_hits_many
from narrascope.operators.sampling import sample_n
from narrascope.plans.reports import emotion_report, semantic_map
from narrascope.sinks.tables import (
    SYMBOL_SUMMARY_COLUMNS, TOPIC_SUMMARY_COLUMNS, write_axis_export, write_by_quadrant, write_corpus,
    write_facts_and_summary, write_scored,
)
from narrascope.sources.reports import (
    distinct_ids, list_files, load_report, read_corpus, read_delimited, read_info, read_quadrant, scan_reports,
)

Query = Callable[[SparkSession, str], DataFrame]
KEY, TEXT = "doc_id", "text"
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select(*columns) if columns else df


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, KEY, TEXT)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their first two entries as x and y."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        "label",
        "embedding",
        F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"),
    )


def in_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("quadrant", vx.quadrant("x", "y"))
    return p.withColumn("quadrant_slug", tx.slug("quadrant"))


def dictionary(spark: SparkSession) -> DataFrame:
    rows = [(i, s, f"meaning {i}") for i, s in P.DICTIONARY]
    return small_table(spark, rows, "ord long, symbol string, meaning string")


def derived_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that grows with the data: every line of every document."""
    d = documents(spark, sf_dir, KEY, TEXT, "source")
    lines = d.select(KEY, "source", F.posexplode(F.split(TEXT, "\n")).alias("pos", "symbol"))
    return lines.select(
        (F.col(KEY) * 1_000_000 + F.col("pos")).alias("ord"), "symbol", F.col("source").alias("meaning")
    )


def lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, P.LEXICON, "word string, valence double")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotion.hybrid_score(
        reports(spark, sf_dir), lexicon(spark), KEY, TEXT, P.NEGATIVE_KEYWORDS, P.POSITIVE_KEYWORDS
    )


def given_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = (F.col("quality") * 2 + F.col("toxic")).alias("topic_id")
    return table(spark, sf_dir, "labels").select(KEY, topic)


def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic_id, term, weight): occurrences of a term in the documents of a given topic."""
    rows = documents(spark, sf_dir, KEY, TEXT).join(given_topics(spark, sf_dir), KEY)
    terms = rows.select(
        "topic_id", F.inline(tx.bag(tx.without(tx.tokens(TEXT, "alpha3"), P.STOP_WORDS)))
    )
    return terms.groupBy("topic_id", "term").agg(F.sum("cnt").cast("double").alias("weight"))


def axes_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir, KEY, TEXT).withColumnRenamed(KEY, "vec_id")
    return extremes.axis_extremes(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", P.N_AXES, P.PER_POLE, texts, TEXT
    )


def answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_id").alias("round_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("responder"),
        F.concat(F.lit("PC"), (F.col("event_id") % 5 + 1).cast("string")).alias("axis"),
        F.when(F.col("event_type").isin("click", "view"), an.WITH_LABELS)
        .otherwise(an.NO_LABELS)
        .alias("condition"),
        (F.get_json_object("props", "$.k").cast("int") % 4 + 1).alias("answer"),
    )


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their key in the same row."""
    a = answer_table(spark, sf_dir)
    key = (F.col("event_id") % 4 + 1).cast("int")
    return a.withColumn("correct", key).withColumn("is_correct", F.col("answer") == key)


def r4(name: str) -> dict:
    return {name: F.round(name, 4)}


# ---------------------------------------------------------------- sources, cleaning, scalars


@query
def dataset_ids(spark, sf_dir):
    return distinct_ids(table(spark, sf_dir, "documents"), "source")


@query
def scan_folder(spark, sf_dir):
    """Write the documents as TSV files with two different headers, and read the folder back."""
    d = documents(spark, sf_dir, KEY, TEXT, "lang").withColumnRenamed(TEXT, "dream")
    folder = scratch_path(spark, "tsv")
    german = F.col("lang") == "de"
    write_corpus(d.where(german).select("dream", KEY), folder, "tsv")
    write_corpus(d.where(~german).select(KEY, "lang", "dream"), folder, "tsv", mode="append")
    corpus, _ = scan_reports(spark, folder, "*.csv")
    return corpus.select(F.col(KEY).cast("long"), "lang", "dream")


@query
def corpus_round_trip(spark, sf_dir):
    """Write all documents as one CSV corpus with quoted multi-line texts, and read it back."""
    path = scratch_path(spark, "corpus")
    write_corpus(documents(spark, sf_dir), path, "csv")
    back = read_corpus(spark, path, "csv")
    return back.withColumns({c: F.col(c).cast("long") for c in (KEY, "n_chars")})


@query
def corpus_by_ranges(spark, sf_dir):
    """The same corpus, every file cut into ranges inside its quoted texts."""
    path = scratch_path(spark, "corpus")
    write_corpus(documents(spark, sf_dir), path, "csv")
    back = read_corpus(spark, path, "csv", by_ranges=True)
    return back.withColumns({c: F.col(c).cast("long") for c in (KEY, "n_chars")})


@query
def one_dataset(spark, sf_dir):
    """The documents as one TSV data set; records with too many fields are left out."""
    d = documents(spark, sf_dir, KEY, TEXT, "lang")
    folder = scratch_path(spark, "dataset")
    write_corpus(d, folder, "tsv")
    too_long = d.select(F.concat_ws("\t", KEY, F.lit("a"), F.lit("b"), F.lit("c")).alias("value"))
    too_long.write.mode("append").text(folder)
    back = read_delimited(spark, folder, d.columns, skip_bad=True)
    return back.withColumn(KEY, F.col(KEY).cast("long"))


@query
def one_quadrant(spark, sf_dir):
    """Write the points by quadrant and read one quadrant's folder."""
    path = scratch_path(spark, "quadrants")
    write_by_quadrant(in_quadrants(spark, sf_dir).drop("quadrant_slug"), path)
    return read_quadrant(spark, path, "dramatic_plus_cognitive").select("vec_id", "x", "y", "quadrant")


@query
def emotion_facts(spark, sf_dir):
    """Scores put back on the full reports."""
    d = documents(spark, sf_dir, KEY, TEXT, "source")
    report = emotion_report(
        d, lexicon(spark), KEY, TEXT, P.NEGATIVE_KEYWORDS, P.POSITIVE_KEYWORDS
    )
    return report.facts.withColumns(r4("sentiment_score"))


@query
def mean_text_length(spark, sf_dir):
    df = stats.mean_text_length(table(spark, sf_dir, "documents"))
    return df.withColumns(r4("mean_length"))


@query
def word_count(spark, sf_dir):
    return reports(spark, sf_dir).select(KEY, tx.word_count(TEXT).alias("word_count"))


@query
def clean_symbols(spark, sf_dir):
    return reports(spark, sf_dir).select(KEY, tx.clean_symbol(TEXT).alias("clean"))


@query
def ellipsize(spark, sf_dir):
    return reports(spark, sf_dir).select(KEY, tx.ellipsize(TEXT, 600).alias("short_text"))


@query
def snippets(spark, sf_dir):
    return reports(spark, sf_dir).select(
        KEY, *[tx.snippet(TEXT, n).alias(f"snippet_{n}") for n in (20, 60, 300)]
    )


@query
def quadrant_slug(spark, sf_dir):
    return in_quadrants(spark, sf_dir).select("vec_id", "quadrant", "quadrant_slug")


def _joined_tokens(spark, sf_dir, words):
    return reports(spark, sf_dir).select(
        KEY, tx.let(words, lambda w: F.concat_ws(":", F.size(w), F.array_join(w, " "))).alias("tokens")
    )


@query
def tokens_word(spark, sf_dir):
    return _joined_tokens(spark, sf_dir, tx.tokens(TEXT))


@query
def tokens_alpha3(spark, sf_dir):
    return _joined_tokens(spark, sf_dir, tx.tokens(TEXT, "alpha3"))


@query
def tokens_no_stop(spark, sf_dir):
    return _joined_tokens(spark, sf_dir, tx.without(tx.tokens(TEXT, "alpha3"), P.STOP_WORDS))


@query
def ngrams(spark, sf_dir):
    grams = F.array_join(tx.ngrams(tx.tokens(TEXT), 1, 3), "|")
    return reports(spark, sf_dir).select(KEY, grams.alias("grams"))


@query
def vector_clean(spark, sf_dir):
    """Entries above 0.2 become infinite, below -0.2 minus infinite, near 0 NaN; then cleaned."""
    spoiled = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(x > 0.2, float("inf"))
        .when(x < -0.2, float("-inf"))
        .when(F.abs(x) < 0.01, float("nan"))
        .otherwise(x),
    )
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(vx.clean_vector(spoiled)).alias("pos", "value")
    )


@query
def quadrant_dim(spark, sf_dir):
    styled = vx.with_quadrant_style(in_quadrants(spark, sf_dir))
    return styled.select("vec_id", "quadrant_slug", "title", "colour")


# ---------------------------------------------------------------- filters


@query
def median_split(spark, sf_dir):
    return stats.median_split(points(spark, sf_dir), "x").select("vec_id", "split_label")


@query
def quadrants(spark, sf_dir):
    """Rows of label 9 have x = NaN and rows of label 8 no x; both get no quadrant."""
    p = points(spark, sf_dir).withColumn(
        "x",
        F.when(F.col("label") == 9, float("nan"))
        .when(F.col("label") == 8, None)
        .otherwise(F.col("x")),
    )
    return p.select("vec_id", vx.quadrant("x", "y").alias("quadrant"))


@query
def sentiment_labels(spark, sf_dir):
    score = points(spark, sf_dir).withColumn("score", F.col("x") * 4)
    return score.select("vec_id", emotion.sentiment_label("score").alias("sentiment_label"))


@query
def groups_with_min_size(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return stats.groups_with_min_size(turns, "conv_id", P.MIN_TURNS)


@query
def sample_n_query(spark, sf_dir):
    return sample_n(table(spark, sf_dir, "documents").select(KEY), P.SAMPLE_SIZE, P.SAMPLE_SEED, KEY)


@query
def vocabulary(spark, sf_dir):
    return topics.vocabulary(reports(spark, sf_dir), TEXT, stop_words=P.STOP_WORDS)


@query
def annotated_points(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col(KEY).alias("vec_id"), TEXT)
    p = points(spark, sf_dir).join(texts, "vec_id")
    return views.annotated_points(p, "vec_id", "x", "y", TEXT)


@query
def load_report_query(spark, sf_dir):
    """Rows of every file of a written folder, and the error of those that could not be read."""
    d = documents(spark, sf_dir, KEY, "source", TEXT).withColumnRenamed(TEXT, "dream")
    folder = scratch_path(spark, "load")
    write_corpus(d.where(F.col("source") != "src0"), f"{folder}/others", "tsv")
    write_corpus(d.where(F.col("source") == "src0"), f"{folder}/first", "tsv")
    found = []
    for name in ("others", "first"):
        corpus, failed = scan_reports(spark, f"{folder}/{name}", "*.csv", skip_failed=True)
        report = load_report(corpus, list_files(spark, f"{folder}/{name}", "*.csv"), failed)
        found.append(report.agg(F.sum("n_rows").alias("n_rows"), F.count("error").alias("n_errors")).withColumn("folder", F.lit(name)))
    return found[0].unionByName(found[1])


@query
def info_files(spark, sf_dir):
    """Metadata of every source as JSON files, read back."""
    folder = scratch_path(spark, "info")
    n = documents(spark, sf_dir, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_dreams"))
    n.select(F.col("source").alias("short_name"), "n_dreams").write.option("ignoreNullFields", False).json(folder)
    return read_info(spark, folder, multi_line=False).select("short_name", "n_dreams")


@query
def symbol_tables(spark, sf_dir):
    """Facts and summary of the symbols under their published names, read back and counted."""
    d = documents(spark, sf_dir, KEY, TEXT, "source")
    index = symbols.SymbolIndex.build(dictionary(spark))
    matched = symbols.symbol_match(d, index, KEY, TEXT)
    path = scratch_path(spark, "symbols")
    write_facts_and_summary(matched, symbols.symbol_summary(matched, index, "source"), path, SYMBOL_SUMMARY_COLUMNS)
    facts = spark.read.parquet(f"{path}/facts").groupBy("matched_symbol").agg(F.sum("word_count").alias("words_in_facts"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/summary")
    return back.select(
        F.col("Symbol").alias("matched_symbol"),
        F.col("Interpretation").alias("interpretation"),
        F.col("how many dreams").cast("long").alias("dreams_count"),
        F.col("how many dreamers").cast("long").alias("dreamers_count"),
        F.col("how many words").cast("long").alias("total_words"),
    ).join(facts, "matched_symbol")


@query
def topic_tables(spark, sf_dir):
    """Facts and summary of given topics under their published names, read back and counted."""
    d = documents(spark, sf_dir, KEY, TEXT, "source").withColumn("word_count", tx.word_count(TEXT))
    facts = d.join(given_topics(spark, sf_dir), KEY)
    keywords = topics.topic_keywords(topics.topic_top_words(topic_weights(spark, sf_dir)))
    summary = topics.topic_summary(facts, stats.resolve_author_col(d)).join(keywords, "topic_id")
    path = scratch_path(spark, "topics")
    write_facts_and_summary(facts, summary, path, TOPIC_SUMMARY_COLUMNS)
    words = spark.read.parquet(f"{path}/facts").groupBy("topic_id").agg(F.sum("word_count").alias("words_in_facts"))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/summary")
    return back.select(
        F.col("id").cast("int").alias("topic_id"),
        F.col("Keywords").alias("keywords"),
        F.col("how many dreams").cast("long").alias("dreams_count"),
        F.col("how many dreamers").cast("long").alias("dreamers_count"),
        F.col("how many words").cast("long").alias("total_words"),
    ).join(words, "topic_id")


@query
def quadrant_results(spark, sf_dir):
    """A result per point written per quadrant; one quadrant is written a second time; read back."""
    rows = in_quadrants(spark, sf_dir).drop("quadrant_slug").select("vec_id", "quadrant", (F.col("x") > F.col("y")).alias("right"))
    rows = materialize(rows, "quadrant-rows")
    path = scratch_path(spark, "quadrant-results")
    write_by_quadrant(rows, path)
    slugs = [r["s"] for r in rows.select(tx.slug("quadrant").alias("s")).distinct().orderBy("s").collect()]
    write_by_quadrant(rows.where(tx.slug("quadrant") == slugs[0]), path, mode="overwrite")
    return read_quadrant(spark, path).select("vec_id", "quadrant", "quadrant_slug", "right")


@query
def scored_table(spark, sf_dir):
    """Scored reports, written and read back."""
    path = scratch_path(spark, "scored")
    write_scored(scored(spark, sf_dir), path)
    return spark.read.parquet(path).select(KEY, F.round("sentiment_score", 4).alias("sentiment_score"), "sentiment_label")


@query
def axis_export_file(spark, sf_dir):
    """The nested JSON export of the axes, read back as one row per dream."""
    found = axes_extremes(spark, sf_dir)
    path = scratch_path(spark, "axes")
    write_axis_export(extremes.axis_export(found, "vec_id", [1.0 / P.N_AXES] * P.N_AXES, 0, "given"), path)
    axis = spark.read.json(path).select(F.explode("axes").alias("a"))
    poles = [axis.select("a.axis_id", F.lit(p).alias("pole"), F.posexplode(f"a.{p}_pole.dreams").alias("rank", "d")) for p in ("positive", "negative")]
    rows = poles[0].union(poles[1])
    return rows.select(
        F.col("axis_id").cast("int"), "pole", (F.col("rank") + 1).alias("rank"), F.col("d.id").alias("vec_id"), F.col("d.text").alias("text")
    )


# ---------------------------------------------------------------- symbols


@query
def symbol_hits(spark, sf_dir):
    return symbols.symbol_hits(reports(spark, sf_dir), dictionary(spark), KEY, TEXT)


@query
def symbol_hits_joined(spark, sf_dir):
    """The route for big dictionaries: phrases joined with the dictionary. Same result."""
    index = symbols.SymbolIndex.build(dictionary(spark), max_literal=0)
    return symbols.symbol_hits(reports(spark, sf_dir), index, KEY, TEXT)


@query
def symbol_counts(spark, sf_dir):
    return symbols.symbol_counts(reports(spark, sf_dir), dictionary(spark), KEY, TEXT)


@query
def symbol_counts_joined(spark, sf_dir):
    index = symbols.SymbolIndex.build(dictionary(spark), max_literal=0)
    return symbols.symbol_counts(reports(spark, sf_dir), index, KEY, TEXT)


@query
def symbol_match_joined(spark, sf_dir):
    index = symbols.SymbolIndex.build(dictionary(spark), max_literal=0)
    matched = symbols.symbol_match(reports(spark, sf_dir), index, KEY, TEXT)
    return matched.select(KEY, "word_count", "matched_symbol", "interpretation")


@query
def symbol_match(spark, sf_dir):
    matched = symbols.symbol_match(reports(spark, sf_dir), dictionary(spark), KEY, TEXT)
    return matched.select(KEY, "word_count", "matched_symbol", "interpretation")


@query
def symbol_summary(spark, sf_dir):
    d = documents(spark, sf_dir, KEY, TEXT, "source")
    index = symbols.SymbolIndex.build(dictionary(spark))
    matched = symbols.symbol_match(d, index, KEY, TEXT)
    summary = symbols.symbol_summary(matched, index, "source")
    return summary.withColumns({**r4("avg_words"), **r4("percent")})


@query
def top_symbols(spark, sf_dir):
    """The twenty most frequent symbols of the summary."""
    columns = ["matched_symbol", "dreams_count", "percent", "interpretation_snippet"]
    return symbols.top_symbols(symbol_summary(spark, sf_dir), 20, columns)


@query
def symbol_dedupe(spark, sf_dir):
    return symbols.dedupe_symbols(derived_dictionary(spark, sf_dir))


@query
def unmatchable_symbols(spark, sf_dir):
    found = symbols.unmatchable_symbols(derived_dictionary(spark, sf_dir))
    return found.select("clean", "ord", "n_words")


@query
def duplicate_symbols(spark, sf_dir):
    return symbols.duplicate_symbols(derived_dictionary(spark, sf_dir))


# ---------------------------------------------------------------- emotion


@query
def keyword_hits(spark, sf_dir):
    return emotion.keyword_hits(
        reports(spark, sf_dir), KEY, TEXT, P.NEGATIVE_KEYWORDS, P.POSITIVE_KEYWORDS
    )


def _many_hits(spark, sf_dir):
    d = reports(spark, sf_dir)
    terms = topics.vocabulary(d, TEXT, min_df=2, max_df=1.0, max_terms=P.MANY_KEYWORDS)
    return keyword_hits_many(d, KEY, TEXT, terms, "term")


@query
def keyword_hits_many_query(spark, sf_dir):
    """How many of 5,000 terms of the corpus a document contains, as substrings, and their letters."""
    hits = _many_hits(spark, sf_dir).groupBy(KEY)
    return hits.agg(F.count(F.lit(1)).alias("n_hits"), F.sum(F.length("keyword")).alias("letters"))


@query
def keyword_reports(spark, sf_dir):
    return keyword_counts(_many_hits(spark, sf_dir))


@query
def lexicon_score(spark, sf_dir):
    s = emotion.lexicon_score(reports(spark, sf_dir), lexicon(spark), KEY, TEXT)
    return s.select(KEY, F.round("base_score", 4).alias("base_score"))


@query
def ruled_score(spark, sf_dir):
    """Base score with boosters, negations, contrast words, capitals and exclamation marks."""
    rules = small_table(spark, P.RULES, "word string, kind string, step double")
    s = emotion.lexicon_score(reports(spark, sf_dir), lexicon(spark), KEY, TEXT, rules=rules)
    return s.select(KEY, F.round("base_score", 4).alias("base_score"))


@query
def hybrid_score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        KEY,
        F.round("base_score", 4).alias("base_score"),
        "neg_hits",
        "pos_hits",
        F.round("sentiment_score", 4).alias("sentiment_score"),
        "sentiment_label",
    )


@query
def two_datasets(spark, sf_dir):
    """Two datasets that number their reports alike: dataset and number name a report."""
    d = reports(spark, sf_dir)
    both = d.withColumn("dataset_id", F.lit("a")).union(d.withColumn("dataset_id", F.lit("b")))
    found = emotion.hybrid_score(
        both, lexicon(spark), ["dataset_id", KEY], TEXT, P.NEGATIVE_KEYWORDS, P.POSITIVE_KEYWORDS
    )
    return found.select("dataset_id", KEY, F.round("sentiment_score", 4).alias("sentiment_score"), "sentiment_label")


@query
def sentiment_distribution(spark, sf_dir):
    return emotion.sentiment_distribution(scored(spark, sf_dir)).withColumns(r4("percent"))


@query
def topic_emotion(spark, sf_dir):
    by_topic = scored(spark, sf_dir).join(given_topics(spark, sf_dir), KEY)
    return emotion.topic_emotion(by_topic).withColumns(r4("avg_sentiment"))


@query
def extreme_reports(spark, sf_dir):
    ends = emotion.extreme_reports(scored(spark, sf_dir), reports(spark, sf_dir), KEY, TEXT)
    return ends.withColumns(r4("sentiment_score"))


# ---------------------------------------------------------------- topics


@query
def term_stats(spark, sf_dir):
    return topics.term_stats(reports(spark, sf_dir), TEXT)


@query
def bag_of_words(spark, sf_dir):
    return topics.bag_of_words(reports(spark, sf_dir), KEY, TEXT)


@query
def topic_top_words(spark, sf_dir):
    return topics.topic_top_words(topic_weights(spark, sf_dir))


@query
def topic_keywords(spark, sf_dir):
    return topics.topic_keywords(topics.topic_top_words(topic_weights(spark, sf_dir)))


@query
def topic_join_keywords(spark, sf_dir):
    keywords = topics.topic_keywords(topics.topic_top_words(topic_weights(spark, sf_dir)))
    return topics.join_keywords(given_topics(spark, sf_dir), keywords)


@query
def dominant_topic(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", topics.dominant_topic("embedding").alias("topic_id"))


@query
def topic_summary(spark, sf_dir):
    counted = documents(spark, sf_dir, KEY, TEXT, "source").select(
        KEY, "source", tx.word_count(TEXT).alias("word_count")
    )
    assigned = counted.join(given_topics(spark, sf_dir), KEY)
    summary = topics.topic_summary(assigned, "source")
    return summary.withColumns({**r4("avg_words"), **r4("percent")})


def _assigned(documents):
    """The topic model of documents, and their assignment; the texts are read once."""
    stored = materialize(variational.with_bags(documents, TEXT, stop_words=P.STOP_WORDS).drop(TEXT), "topic-bags")
    model = variational.topics_fit_batch(stored, None, stop_words=P.STOP_WORDS, bag_col="bag")
    return model, model.assign(stored, None, "bag")


@query
def topics_step(spark, sf_dir):
    """One pass of the topic fit over all documents from given weights."""
    d = reports(spark, sf_dir)
    vocab = topics.vocabulary(d, TEXT, stop_words=P.STOP_WORDS, max_terms=P.STEP_TERMS)
    terms = sorted(r["term"] for r in vocab.select("term").collect())
    topic, term = np.indices((P.STEP_TOPICS, len(terms)))
    start = 1.0 + (7 * term + 3 * topic) % 5
    features = variational.count_features(d, TEXT, terms, stop_words=P.STOP_WORDS)
    prior = 1 / P.STEP_TOPICS
    weights, _ = variational.topics_step(features, start, prior, prior, P.STEP_INNER, 0.0)
    rows = [(z + 1, t, float(w)) for z, row in enumerate(weights) for t, w in zip(terms, row)]
    return small_table(spark, rows, "topic_id int, term string, weight double").withColumns(r4("weight"))


@query
def lda_topics(spark, sf_dir):
    return variational.topics_fit_batch(reports(spark, sf_dir), TEXT, stop_words=P.STOP_WORDS).top_words()


@query
def lda_assign(spark, sf_dir):
    d = documents(spark, sf_dir, KEY, TEXT, "source").withColumn("word_count", tx.word_count(TEXT))
    _, assigned = _assigned(d)
    return assigned.select(KEY, "source", "word_count", "topic_id")


@query
def lda_checks(spark, sf_dir):
    """What holds for any fit: every document once, weights that sum to one, topic numbers in range.

    A document without any term of the vocabulary has no weights.
    """
    model, found = _assigned(reports(spark, sf_dir))
    total = F.aggregate("topic_weights", F.lit(0.0), lambda s, w: s + w)
    top = model.top_words()
    heavier = top.alias("a").join(top.alias("b"), F.expr("a.topic_id = b.topic_id and a.rank + 1 = b.rank and a.weight < b.weight"))
    return found.agg(
        F.count_distinct(KEY).alias("n_docs"),
        F.count_if((F.abs(total - 1) > 1e-6) & (total > 0)).alias("n_bad_sums"),
        F.count_if(~F.col("topic_id").between(1, 100)).alias("n_bad_topics"),
    ).withColumns({"n_topics": F.lit(top.select("topic_id").distinct().count()), "n_unordered": F.lit(heavier.count())})


# ---------------------------------------------------------------- joins, counts, unions


@query
def reports_with_coords(spark, sf_dir):
    coords = points(spark, sf_dir).select(F.col("vec_id").alias(KEY), "x", "y")
    d = table(spark, sf_dir, "documents").select(KEY, "source", TEXT)
    return d.join(coords, KEY)


@query
def source_counts(spark, sf_dir):
    return stats.source_counts(table(spark, sf_dir, "documents"), "source")


@query
def union_by_name(spark, sf_dir):
    return stats.union_by_name(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    )


@query
def quadrant_counts(spark, sf_dir):
    return stats.count_by(in_quadrants(spark, sf_dir), "quadrant")


# ---------------------------------------------------------------- vectors


def _given_centres(spark, sf_dir) -> np.ndarray:
    rows = (
        table(spark, sf_dir, "embeddings")
        .where(F.col("vec_id") < P.N_CENTRES)
        .orderBy("vec_id")
        .select("embedding")
    )
    return np.asarray([r["embedding"] for r in rows.collect()], dtype=np.float64)


@query
def feature_hash(spark, sf_dir):
    v = feature_hash_embed(reports(spark, sf_dir), TEXT, P.HASH_DIM)
    entries = v.select(KEY, F.posexplode("embedding").alias("slot", "value"))
    return entries.where("value <> 0").withColumns(r4("value"))


@query
def project_axes(spark, sf_dir):
    """Centred projection on the first two given vectors taken as axes."""
    e = table(spark, sf_dir, "embeddings")
    axes = _given_centres(spark, sf_dir)[:2].T
    coords = vx.project("embedding", {"": axes}, {"": pca.mean_vector(e)})
    out = pca.with_coordinates(e, coords, ("a1", "a2")).select("vec_id", "a1", "a2")
    return out.withColumns({**r4("a1"), **r4("a2")})


@query
def covariance(spark, sf_dir):
    cov = pca.covariance(table(spark, sf_dir, "embeddings"))
    return cov.withColumn("cov", F.round("cov", 6))


@query
def kmeans_assign(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return clusters.kmeans_assign(e, _given_centres(spark, sf_dir)).select("vec_id", "cluster")


@query
def cluster_sizes(spark, sf_dir):
    return clusters.cluster_sizes(kmeans_assign(spark, sf_dir))


@query
def pca_variance(spark, sf_dir):
    """Share of the variance of PC1..PC5; the global fit and the four local fits."""
    q = in_quadrants(spark, sf_dir)
    models = {"all": pca.pca_fit(q, 5), **pca.pca_fit_by(q, "quadrant_slug", 5)}
    found = pca.pca_variance(spark, models)
    return found.withColumns({**r4("variance_ratio"), **r4("cumulative_ratio")})


@query
def group_variance(spark, sf_dir):
    """Rows and total variance of every quadrant, from the sums that the local fits use."""
    models = pca.pca_fit_by(in_quadrants(spark, sf_dir), "quadrant_slug", 1)
    rows = [(g, m.n, m.total_variance) for g, m in sorted(models.items())]
    found = small_table(spark, rows, "quadrant_slug string, n long, total_variance double")
    return found.withColumn("total_variance", F.round("total_variance", 6))


@query
def pca_coords(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    coords = pca.pca_transform(e, pca.pca_fit(e, 2)).select("vec_id", "pca1", "pca2")
    return coords.withColumns({**r4("pca1"), **r4("pca2")})


@query
def pca_by_group(spark, sf_dir):
    q = in_quadrants(spark, sf_dir)
    models = pca.pca_fit_by(q, "quadrant_slug", 2)
    out = pca.pca_transform(q, models, ("q_pca1", "q_pca2"), group="quadrant_slug")
    out = out.select("vec_id", "quadrant_slug", "q_pca1", "q_pca2")
    return out.withColumns({**r4("q_pca1"), **r4("q_pca2")})


@query
def pca_checks(spark, sf_dir):
    """Per quadrant with all components: zero means and cross terms, and the spread of the vectors kept."""
    q = in_quadrants(spark, sf_dir)
    n = len(q.select("embedding").first()["embedding"])
    names = [f"c{i}" for i in range(n)]
    models = pca.pca_fit_by(q, "quadrant_slug", n)
    out = pca.pca_transform(q, models, names, group="quadrant_slug").where("c0 is not null")
    squares = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))
    return out.groupBy("quadrant_slug").agg(
        F.count(F.lit(1)).alias("n"),
        (F.greatest(*(F.abs(F.avg(c)) for c in names)) < 1e-6).alias("centred"),
        (F.abs(F.covar_pop("c0", "c1")) + F.abs(F.covar_pop("c1", "c2")) < 1e-6).alias("uncorrelated"),
        F.round(F.sum(squares), 3).alias("sum_squares"),
    )


@query
def kmeans_step(spark, sf_dir):
    """One iteration of the grouped fit from the same given centres in every quadrant."""
    q = in_quadrants(spark, sf_dir).select(F.col("quadrant_slug").alias("grp"), F.col("embedding").alias("v"))
    names = [r["grp"] for r in q.where("grp is not null").select("grp").distinct().collect()]
    means, counts = clusters.lloyd_step(q, dict.fromkeys(names, _given_centres(spark, sf_dir)))
    rows = [
        (g, c, int(counts[g][c]), i, float(v))
        for g in sorted(names) for c, mean in enumerate(means[g]) for i, v in enumerate(mean)
    ]
    return small_table(spark, rows, "quadrant_slug string, cluster int, n long, i int, v double").withColumns(r4("v"))


@query
def kmeans_checks(spark, sf_dir):
    """Rows and clusters per quadrant, and rows that lie nearer to another cluster's mean than to their own."""
    q = in_quadrants(spark, sf_dir)
    found = materialize(clusters.kmeans_by(q, "quadrant_slug").where("cluster is not null"), "kmeans-checks")
    own = found.select("quadrant_slug", "cluster", F.posexplode("embedding").alias("i", "v"))
    means = own.groupBy("quadrant_slug", "cluster", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    means = means.groupBy("quadrant_slug", "cluster").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    means = means.groupBy("quadrant_slug").agg(F.collect_list(F.struct("cluster", F.col("m.v").alias("v"))).alias("centres"))

    def distance(m):
        return F.aggregate(F.zip_with("embedding", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    near = F.transform("centres", lambda c: F.struct(distance(c["v"]).alias("d"), c["cluster"].alias("cluster")))
    mine = F.filter(near, lambda c: c["cluster"] == F.col("cluster"))[0]["d"]
    joined = found.join(means, "quadrant_slug").withColumn("away", mine > F.array_min(near)["d"] * 1.05 + 1e-9)
    return joined.groupBy("quadrant_slug").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("n_clusters"), F.count_if("away").alias("n_away")
    )


@query
def kmeans_by_group(spark, sf_dir):
    q = in_quadrants(spark, sf_dir)
    return clusters.kmeans_by(q, "quadrant_slug").select("vec_id", "quadrant_slug", "cluster")


@query
def local_map(spark, sf_dir):
    """Map, quadrants, local maps and clusters in one go."""
    found = semantic_map(table(spark, sf_dir, "embeddings"), "vec_id").points
    return found.select("vec_id", "quadrant", "pca1", "pca2", "q_pca1", "q_pca2", "cluster")


def trigram_encoder(dim: int = 32):
    """A small deterministic encoder: hashed character trigrams with unit length."""

    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in zip(out, texts):
                raw = np.frombuffer(str(text).encode("utf-8"), dtype=np.uint8).astype(np.int64)
                if raw.size >= 3:
                    grams = (raw[:-2] * 65_599 + raw[1:-1] * 257 + raw[2:]) % dim
                    row += np.bincount(grams, minlength=dim)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm == 0, 1, norm)

        return predict

    return load


@query
def embed_encoder(spark, sf_dir):
    """Encode every document, write the vectors once, and map them."""
    vectors = embed(reports(spark, sf_dir), trigram_encoder(), TEXT).select(KEY, "embedding")
    stored = materialize(vectors, "vectors")
    coords = pca.pca_transform(stored, pca.pca_fit(stored, 2)).select(KEY, "pca1", "pca2")
    return coords.withColumns({**r4("pca1"), **r4("pca2")})


# ---------------------------------------------------------------- extremes and rounds


@query
def axis_extremes(spark, sf_dir):
    return axes_extremes(spark, sf_dir)


@query
def intruder_rounds(spark, sf_dir):
    rounds = extremes.make_rounds(axes_extremes(spark, sf_dir), "vec_id", P.N_ROUNDS, P.ROUND_SEED)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return rounds.select(
        "axis_id", "round", "shown", "correct", ids.alias("ids"), F.array_join("texts", "|").alias("texts")
    )


@query
def graded_answers(spark, sf_dir):
    rounds = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("round_id"), (F.col("event_id") % 4 + 1).cast("int").alias("correct")
    )
    out = an.grade(answer_table(spark, sf_dir), rounds)
    return out.select("event_id", "responder", "axis", "condition", "answer", "correct", "is_correct")


@query
def accuracy(spark, sf_dir):
    return an.accuracy(graded(spark, sf_dir)).withColumns(r4("accuracy"))


@query
def accuracy_pivot(spark, sf_dir):
    wide = an.accuracy_pivot(graded(spark, sf_dir), P.AXES)
    return wide.withColumns({c: F.round(c, 4) for c in (*P.AXES, an.OVERALL)})


@query
def label_boost(spark, sf_dir):
    boost = an.label_boost(graded(spark, sf_dir))
    return boost.withColumns({**r4("with_labels"), **r4("no_labels")})


@query
def published_accuracy(spark, sf_dir):
    """Accuracy nested as it is published, per responder and type, and taken apart again."""
    facts = an.accuracy(graded(spark, sf_dir)).withColumn("responder_type", F.when(F.col("responder") == P.HUMAN, "human").otherwise("model"))
    axes = facts.groupBy("responder", "responder_type", "condition").agg(F.map_from_entries(F.collect_list(F.struct("axis", "accuracy"))).alias("a"))
    nested = axes.groupBy("responder", "responder_type").agg(F.map_from_entries(F.collect_list(F.struct("condition", "a"))).alias("results"))
    return an.published_accuracy(nested).withColumns(r4("percent"))


@query
def vs_human(spark, sf_dir):
    gap = an.vs_human(graded(spark, sf_dir), P.HUMAN)
    return gap.withColumns({**r4("accuracy"), **r4("human_accuracy")})


@query
def panel_accuracy(spark, sf_dir):
    return an.panel_accuracy(graded(spark, sf_dir), ("axis", "correct"))


@query
def responder_scores(spark, sf_dir):
    return an.responder_scores(graded(spark, sf_dir))


# ---------------------------------------------------------------- plot tables


@query
def scatter_bins(spark, sf_dir):
    return views.scatter_bins(points(spark, sf_dir), "x", "y", P.BINS, "label")


@query
def scatter_sample(spark, sf_dir):
    q = in_quadrants(spark, sf_dir)
    found = views.scatter_sample(q, "quadrant_slug", P.PER_LABEL, P.SAMPLE_SEED, "vec_id")
    styled = vx.with_quadrant_style(found)
    return styled.select("vec_id", "quadrant_slug", "rank", "x", "y", "colour")
