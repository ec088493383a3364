"""Containment of many keywords: one automaton over the keyword table, each text read once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.sizing import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, as_list, materialize
from narrascope.operators.stats import drop_null_text

# Rows after which a task hands on what it has found.
_FLUSH_ROWS = 100_000


def _search(words: Sequence[str]):
    """Rows of the first columns with every word that the last column contains, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()

        for batch in batches:
            keys = batch.select(batch.schema.names[:-1])
            rows: list[int] = []
            found: list[str] = []

            def flush() -> pa.RecordBatch:
                columns = [*keys.take(pa.array(rows, pa.int64())).columns, pa.array(found, pa.string())]
                rows.clear()
                found.clear()
                return pa.RecordBatch.from_arrays(columns, names=[*keys.schema.names, "keyword"])

            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                hits = {word for _, word in automaton.iter(text.as_py())} if words else ()
                rows.extend([i] * len(hits))
                found.extend(hits)
                if len(rows) >= _FLUSH_ROWS:
                    yield flush()
            yield flush()

    return run


def keyword_hits_many(
    reports: DataFrame,
    key: str | Sequence[str],
    text_col: str,
    keywords: DataFrame,
    keyword_col: str = "keyword",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """(key, keyword): one row per report and different keyword that its text contains, in lower case.

    For lists beyond what one expression per keyword can hold. The work is linear in the length of the text
    and its matches. The automaton goes to every task, so its words are bounded in number and bytes: a longer
    list is dealt by a hash into lists that are half full on average, and the texts are read once per list.
    Null and empty keywords match nothing; repeated ones count once. Null texts are left out, equal keys stay
    apart as rows. Texts are not shuffled.
    """
    k = as_list(key)
    word = F.lower(F.col(keyword_col))
    words = keywords.select(word.alias("keyword")).where("keyword <> ''").distinct()
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("keyword")).alias("bytes")).first()
    full = max(size["n"] / max_rows, (size["bytes"] or 0) / max_bytes)
    parts = 1 if full <= 1 else math.ceil(2 * full)

    text = F.lower(F.col(text_col)).alias("_text")
    rows = drop_null_text(reports, text_col).select(*k, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "keyword string"])

    def one(part: int) -> DataFrame:
        own = words.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part) if parts > 1 else words
        return rows.mapInArrow(_search([r["keyword"] for r in own.toLocalIterator()]), schema)

    if parts == 1:
        return one(0)
    # Stored one after the other, so that the driver never holds two lists.
    found = materialize(one(0), "keyword-hits")
    for part in range(1, parts):
        found = found.unionByName(materialize(one(part), "keyword-hits"))
    return found


def keyword_counts(hits: DataFrame) -> DataFrame:
    """(keyword, n_reports) of found keywords, the most frequent first."""
    counted = hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_reports"))
    return counted.orderBy(F.desc("n_reports"), "keyword")
