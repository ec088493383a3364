"""Symbol dictionary: cleaning, first-wins deduplication, 1-3-word matching, best symbol, summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import MAX_BROADCAST_BYTES, as_list, broadcast_if_small, materialize, small_table
from narrascope.operators.phrases import BITS_PER_PHRASE, PhraseFilter
from narrascope.operators.stats import drop_null_text, with_percent

UNCATEGORIZED = "Uncategorized"
NO_MATCH = "No match found"
# Up to this many symbols the dictionary travels inside the expression and matching is row-local;
# beyond it, phrases that pass a filter of the dictionary are joined with it.
MAX_LITERAL_SYMBOLS = 5_000
# Fixed value: a phrase that tokenising can produce: one to three tokens with one blank between.
MATCHABLE = r"^[\p{L}\p{N}_]+( [\p{L}\p{N}_]+){0,2}$"
_SEP = "\x1f"


def dedupe_symbols(
    dictionary: DataFrame, symbol: str = "symbol", meaning: str = "meaning", ord_col: str = "ord"
) -> DataFrame:
    """One row per clean symbol: the entry that comes first in the dictionary."""
    entry = F.struct(
        F.col(ord_col).alias("ord"), F.col(symbol).alias("symbol"), F.col(meaning).alias("meaning")
    )
    return (
        dictionary.where(F.col(symbol).isNotNull())
        .withColumn("clean", tx.clean_symbol(symbol))
        .groupBy("clean")
        .agg(F.min_by(entry, F.col(ord_col)).alias("e"), F.count(F.lit(1)).alias("n_entries"))
        .select(
            "clean",
            "e.ord",
            "e.symbol",
            "e.meaning",
            tx.word_count("clean").alias("n_words"),
            F.col("clean").rlike(MATCHABLE).alias("matchable"),
            "n_entries",
        )
    )


def duplicate_symbols(dictionary: DataFrame, symbol: str = "symbol") -> DataFrame:
    """How many dictionary entries go away with deduplication."""
    clean = dictionary.where(F.col(symbol).isNotNull()).select(tx.clean_symbol(symbol).alias("c"))
    per_symbol = clean.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return per_symbol.agg(
        F.sum("n").alias("n_entries"),
        F.count(F.lit(1)).alias("n_symbols"),
        F.sum(F.col("n") - 1).alias("n_removed"),
    )


def unmatchable_symbols(dictionary: DataFrame, **columns: str) -> DataFrame:
    """Symbols that no text can match: more than three words, or characters that split tokens."""
    return dedupe_symbols(dictionary, **columns).where(~F.col("matchable"))


@dataclass
class SymbolIndex:
    """Deduplicated matchable symbols; when they are few, `ranked` holds them on the driver too.

    When they are many, the table is stored, and a filter of its phrases is built on first use.
    """

    table: DataFrame
    ranked: list[str] | None = None
    first_words: dict[int, list[str]] = field(default_factory=dict)
    bits_per_phrase: float = BITS_PER_PHRASE
    _filter: PhraseFilter | None = None

    @classmethod
    def build(
        cls,
        dictionary: DataFrame,
        max_literal: int = MAX_LITERAL_SYMBOLS,
        bits_per_phrase: float = BITS_PER_PHRASE,
        **columns: str,
    ):
        table = dedupe_symbols(dictionary, **columns).where("matchable")
        table = table.select("clean", "ord", "symbol", "meaning", "n_words")
        rows = table.limit(max_literal + 1).collect()
        if len(rows) > max_literal or sum(len(r["meaning"] or "") for r in rows) > MAX_BROADCAST_BYTES:
            return cls(materialize(table, "symbols"), bits_per_phrase=bits_per_phrase)
        rows.sort(key=lambda r: (-r["n_words"], r["ord"]))
        schema = "clean string, ord long, symbol string, meaning string, n_words int"
        table = small_table(dictionary.sparkSession, rows, schema)
        firsts: dict[int, set[str]] = {}
        for r in rows:
            firsts.setdefault(r["n_words"], set()).add(r["clean"].split(" ")[0])
        return cls(
            table,
            [r["clean"] for r in rows],
            {n: sorted(words) for n, words in sorted(firsts.items())},
        )

    def columns(self, *columns: Column | str) -> DataFrame:
        """Columns of the dictionary for a join, broadcast when the size has been checked."""
        part = self.table.select(*columns)
        return broadcast_if_small(part) if self.ranked is None else F.broadcast(part)

    def likely(self, reports: DataFrame, text_col: str) -> DataFrame:
        """`reports` with `_likely`, the phrases that may be symbols; few of them are not."""
        if self._filter is None:
            self._filter = PhraseFilter.build(self.table, "clean", self.bits_per_phrase)
        return self._filter.likely(reports, text_col, "_likely")

    def symbols(self) -> Column:
        """The matchable symbols as one constant array, most words first, then dictionary order."""
        if not self.ranked:
            return F.array().cast("array<string>")
        return F.split(F.lit(_SEP.join(self.ranked)), _SEP)

    def phrases(self, words: Column) -> Column:
        """The phrases of a text that may be symbols.

        A phrase is only built where its first word starts a symbol of that length.
        """

        def of_size(t: Column, n: int) -> Column:
            if n == 1:
                return t
            here = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(
                F.array().cast("array<int>")
            )
            starts = F.filter(here, lambda i: F.get(t, i).isin(*self.first_words[n]))
            return F.transform(
                starts, lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(n)])
            )

        if not self.first_words:
            return F.array().cast("array<string>")
        return tx.let(words, lambda t: F.concat(*[of_size(t, n) for n in self.first_words]))


def _index(dictionary: DataFrame | SymbolIndex) -> SymbolIndex:
    return dictionary if isinstance(dictionary, SymbolIndex) else SymbolIndex.build(dictionary)


def _numbered(reports: DataFrame) -> DataFrame:
    """`reports` with a number of its own for every row, stored so that it stays the same.

    Rows may share a key or have none; the best symbol of a report goes by this number.
    """
    return materialize(reports.withColumn("_row", F.monotonically_increasing_id()), "symbol-reports")


def symbol_hits(
    reports: DataFrame, dictionary: DataFrame | SymbolIndex, key: str | Sequence[str], text_col: str
) -> DataFrame:
    """(key, clean, ord, n_words): every symbol that occurs in a report, once."""
    index, keys = _index(dictionary), as_list(key)
    reports = drop_null_text(reports, text_col)
    if index.ranked is None:
        found = index.likely(reports.select(*keys, text_col), text_col)
        found = found.select(*keys, F.explode(F.array_distinct("_likely")).alias("clean"))
    else:
        hits = F.array_intersect(index.symbols(), index.phrases(tx.tokens(text_col)))
        found = reports.select(*keys, F.explode(hits).alias("clean"))
    return found.join(index.columns("clean", "ord", "n_words"), "clean").select(*keys, "clean", "ord", "n_words")


def symbol_counts(
    reports: DataFrame, dictionary: DataFrame | SymbolIndex, key: str | Sequence[str], text_col: str
) -> DataFrame:
    """(key, clean, cnt): how often each symbol occurs in a report."""
    index, keys = _index(dictionary), as_list(key)
    reports = drop_null_text(reports, text_col)
    if index.ranked is None:
        found = index.likely(reports.select(*keys, text_col), text_col).select(*keys, F.inline(tx.bag("_likely")))
        found = found.select(*keys, F.col("term").alias("clean"), "cnt")
        return found.join(index.columns("clean"), "clean", "left_semi").select(*keys, "clean", "cnt")
    if not index.ranked:
        return reports.limit(0).select(*keys, F.lit("").alias("clean"), F.lit(0).cast("long").alias("cnt"))
    known = F.filter(index.phrases(tx.tokens(text_col)), lambda g: g.isin(*index.ranked))
    return reports.select(*keys, F.inline(tx.bag(known))).select(
        *keys, F.col("term").alias("clean"), "cnt"
    )


def symbol_match(
    reports: DataFrame, dictionary: DataFrame | SymbolIndex, key: str | Sequence[str], text_col: str
) -> DataFrame:
    """All columns of `reports` with `word_count`, `matched_symbol` and `interpretation`.

    The best symbol has the most words; among equals the earlier dictionary entry wins. Reports
    without a symbol are kept, and rows that share a key are matched one by one. With a dictionary of
    up to `MAX_LITERAL_SYMBOLS` symbols the match is a row-local expression and the reports are not
    shuffled. With a larger one, reports without a phrase that passes the filter are only read; the others
    are numbered, stored, and joined once with the best symbol of each. As both parts are read from
    `reports`, it has to give the same rows each time.
    """
    index = _index(dictionary)
    reports = drop_null_text(reports, text_col).withColumn("word_count", tx.word_count(text_col))
    if index.ranked is None:
        told = index.likely(reports, text_col)
        nothing = F.lit(None).cast("string")
        none = told.where(F.size("_likely") == 0).drop("_likely")
        none = none.withColumns({"matched_symbol": nothing, "interpretation": nothing})
        some = _numbered(told.where(F.size("_likely") > 0))
        hits = some.select("_row", F.explode(F.array_distinct("_likely")).alias("clean"))
        hits = hits.join(index.columns("clean", "ord", "n_words", "symbol", "meaning"), "clean")
        found = F.struct(F.col("symbol").alias("matched_symbol"), F.col("meaning").alias("interpretation"))
        best = hits.groupBy("_row").agg(F.min_by(found, F.struct(-F.col("n_words"), F.col("ord"))).alias("_best"))
        some = some.join(best, "_row", "left").select("*", "_best.*").drop("_row", "_best", "_likely")
        matched = none.unionByName(some)
    else:
        info = index.columns(
            F.col("clean").alias("_best"),
            F.col("symbol").alias("matched_symbol"),
            F.col("meaning").alias("interpretation"),
        )
        hits = F.array_intersect(index.symbols(), index.phrases(tx.tokens(text_col)))
        matched = reports.withColumn("_best", F.get(hits, F.lit(0))).join(info, "_best", "left").drop("_best")
    return matched.withColumn("matched_symbol", F.coalesce("matched_symbol", F.lit(UNCATEGORIZED)))


def symbol_summary(
    matched: DataFrame, dictionary: DataFrame | SymbolIndex, author_col: str | None
) -> DataFrame:
    """Reports, words, mean words, authors and percent per matched symbol, most frequent first."""
    index = _index(dictionary)
    authors = F.countDistinct(author_col) if author_col else F.lit(0).cast("long")
    stats = matched.groupBy("matched_symbol").agg(
        F.count(F.lit(1)).alias("dreams_count"),
        F.sum("word_count").alias("total_words"),
        F.avg("word_count").alias("avg_words"),
        authors.alias("dreamers_count"),
    )
    meanings = index.columns(
        F.col("symbol").alias("matched_symbol"), F.col("meaning").alias("interpretation")
    )
    text = F.when(F.col("matched_symbol") == UNCATEGORIZED, NO_MATCH).otherwise(
        F.coalesce("interpretation", F.lit(""))
    )
    return (
        with_percent(stats, "dreams_count")
        .join(meanings, "matched_symbol", "left")
        .withColumn("interpretation", text)
        .orderBy(F.desc("dreams_count"), "matched_symbol")
    )


def top_symbols(summary: DataFrame, n: int = 20, columns: Sequence[str] | None = None) -> DataFrame:
    """The n most frequent symbols with a 60-character snippet of their meaning."""
    out = summary.orderBy(F.desc("dreams_count"), "matched_symbol").limit(n)
    out = out.withColumn("interpretation_snippet", tx.snippet("interpretation", 60))
    return out.select(*columns) if columns else out
