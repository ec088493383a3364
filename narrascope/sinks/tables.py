"""Writing results: corpora, per-quadrant tables, fact and summary tables, the nested axis export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as tx

# Column names of the published summaries.
TOPIC_SUMMARY_COLUMNS = {
    "topic_id": "id",
    "keywords": "Keywords",
    "dreams_count": "how many dreams",
    "dreamers_count": "how many dreamers",
    "total_words": "how many words",
}
SYMBOL_SUMMARY_COLUMNS = {
    "matched_symbol": "Symbol",
    "interpretation": "Interpretation",
    "dreams_count": "how many dreams",
    "dreamers_count": "how many dreamers",
    "total_words": "how many words",
}


def write_corpus(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Parquet, or CSV / TSV files that `read_corpus` and `scan_reports` read back unchanged."""
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        writer = (
            writer.format("csv")
            .option("sep", "," if fmt == "csv" else "\t")
            .option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    else:
        writer = writer.format(fmt)
    writer.save(path)


def write_by_quadrant(
    df: DataFrame, path: str, quadrant_col: str = "quadrant", mode: str = "errorifexists"
) -> None:
    """One folder per quadrant, for points and for results per quadrant alike.

    Rows are brought together by folder in parts of the advisory size of adaptive execution, so that a folder
    has as many files as its size needs: small quadrants one, a quadrant with most of the rows many, each by a
    task of its own. With mode `overwrite` only the folders of quadrants in `df` are replaced, so a run over
    one quadrant can be repeated. Points without a quadrant are left out.
    """
    named = df.where(F.col(quadrant_col).isNotNull()).withColumn(
        "quadrant_slug", tx.slug(quadrant_col)
    )
    spread = named.hint("rebalance", "quadrant_slug")
    writer = spread.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("quadrant_slug").parquet(path)


def renamed(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(name) for c, name in columns.items()])


def write_facts_and_summary(
    facts: DataFrame,
    summary: DataFrame,
    path: str,
    summary_columns: Mapping[str, str],
    mode: str = "errorifexists",
) -> None:
    """`<path>/facts` as Parquet, `<path>/summary` as CSV under the published column names."""
    facts.write.mode(mode).parquet(f"{path}/facts")
    renamed(summary, summary_columns).write.mode(mode).option("header", True).option(
        "escape", '"'
    ).csv(f"{path}/summary")


def write_scored(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    scored.write.mode(mode).parquet(path)


def write_axis_export(export: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one-row nested export as JSON."""
    export.coalesce(1).write.mode(mode).json(path)
