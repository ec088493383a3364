"""Reading report files: TSV folders with provenance, dataset info, combined corpora, quadrants."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.functions.sizing import materialize, small_table
from narrascope.operators.stats import union_by_name
from narrascope.sources.ranges import read_records

SOURCE_COLUMN = "source_filename"
_CORRUPT = "_corrupt_record"
_PATH = "_path"
_HEADER_BYTES = 1 << 16

# The texts that stand for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

INFO_SCHEMA = T.StructType(
    [
        T.StructField("short_name", T.StringType()),
        T.StructField("long_name", T.StringType()),
        T.StructField("n_dreams", T.LongType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("sex", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def dataset_id(file_name: Column | str) -> Column:
    """The file name before its first dot."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.split_part(name, F.lit("."), F.lit(1))


def _plain_name(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _scanned_file() -> Column:
    """Plain name of the file a row comes from; the metadata column holds it URL-encoded."""
    return _plain_name(F.col("_metadata.file_name"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, file_name) of a folder; the contents are not read and empty files are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def distinct_ids(names: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Sorted distinct dataset ids of a table of file names."""
    return names.select(dataset_id(file_name).alias("dataset_id")).distinct().orderBy("dataset_id")


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_ids(list_files(spark, folder))


def column_names(header: Sequence[str]) -> list[str]:
    """Column names of a header; empty names and repeated names are made unique."""
    names: list[str] = []
    for i, raw in enumerate(header):
        base = raw if raw else f"Unnamed: {i}"
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def _first_line(path: str, whole: bool = False) -> str:
    """The header line, read with at most one small request; `whole` reads the rest too and drops it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        store, name = fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    else:
        uri = "s3:" + rest if scheme in ("s3a", "s3n") else path
        store, name = fs.FileSystem.from_uri(uri)
    line = b""
    with store.open_input_stream(name) as stream:
        while b"\n" not in line:
            chunk = stream.read(_HEADER_BYTES)
            if not chunk:
                break
            line += chunk
        while whole and stream.read(_HEADER_BYTES * 256):
            pass
    return line.split(b"\n")[0].decode("utf-8-sig").rstrip("\r")


def _peek(batches: Iterator[pd.DataFrame], whole: bool = False) -> Iterator[pd.DataFrame]:
    for files in batches:
        lines, errors = [], []
        for path in files["path"]:
            try:
                line = _first_line(path, whole)
                lines.append(line or None)
                errors.append(None if line else "empty file")
            except Exception as e:  # one bad file must not stop the others
                lines.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield files.assign(header=lines, error=errors)


def read_headers(spark: SparkSession, folder: str, glob: str = "*.tsv", whole: bool = False) -> DataFrame:
    """(path, file_name, header, error): the tasks open each file once and read its first line.

    With `whole` they read on to the end, so that a damaged file shows.
    """
    files = list_files(spark, folder, glob)
    files = files.repartition(spark.sparkContext.defaultParallelism, "path")

    def peek(batches):
        yield from _peek(batches, whole)

    return files.mapInPandas(peek, "path string, file_name string, header string, error string")


def _field_count(raw: Column, sep: str) -> Column:
    """Number of fields of a raw record; separators inside quotes do not count."""
    bare = F.regexp_replace(raw, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    sep: str = "\t",
    multi_line: bool = True,
    with_source: bool = False,
    missing: Sequence[str] = MISSING_TEXTS,
    skip_bad: bool = False,
    by_ranges: bool = False,
) -> DataFrame:
    """Files with one common header as all-string columns.

    A record with too many fields is an error, or left out with `skip_bad`; a damaged file is always an
    error. Short records are padded with null, missing-value texts become null. `multi_line=False` lets big files be split into many tasks; use it where texts hold
    no line breaks. A file with quoted line breaks is read by one task, or with `by_ranges` by many, if its
    quotes are balanced and stand only around and, doubled, inside quoted fields (see `read_records`).
    """
    fields = [T.StructField(c, T.StringType()) for c in columns]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"sep": sep, "multiLine": multi_line, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    options["columnNameOfCorruptRecord"] = _CORRUPT
    if by_ranges:
        names = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema)
        parsed = F.from_csv("record", names, {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
        df = read_records(spark, paths).select(F.inline(F.array(parsed)), F.col("path").alias(_PATH))
        source = F.element_at(F.split(_PATH, "/"), -1)
    else:
        df = (
            spark.read.schema(schema)
            .options(**options)
            .option("header", True)
            .option("columnPruning", False)
            .option("ignoreCorruptFiles", False)
            .csv(paths if isinstance(paths, str) else list(paths))
        )
        source = F.col("_metadata.file_name")
    raw = F.col(_CORRUPT)
    # The reader refuses queries that need the raw record alone (a count), so the filter also looks
    # at the first column.
    first = F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))
    fits = raw.isNull() | (_field_count(raw, sep) <= len(columns))
    if not skip_bad:
        message = F.concat(F.lit("more fields than columns: "), F.substring(raw, 1, 200))
        fits = F.when(fits, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    kept = df.where((F.octet_length(first) >= 0) & fits)
    out = [
        F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in columns
    ]
    if with_source:
        out.append(_plain_name(source).alias(SOURCE_COLUMN))
    return kept.select(*out)


def _header_columns(line: str, sep: str) -> list[str]:
    return column_names(next(csv.reader(io.StringIO(line), delimiter=sep)))


def read_reports(
    spark: SparkSession,
    folder: str,
    dataset: str,
    multi_line: bool = True,
    skip_bad: bool = False,
    by_ranges: bool = False,
) -> DataFrame:
    """One dataset: `<folder>/<dataset>.tsv`, all columns string; see `read_delimited` for the choices."""
    header = read_headers(spark, folder, f"{dataset}.tsv").first()
    if header is None or header["header"] is None:
        raise ValueError(f"dataset {dataset!r}: {header['error'] if header else 'no such file'}")
    columns = _header_columns(header["header"], "\t")
    return read_delimited(
        spark, header["path"], columns, multi_line=multi_line, skip_bad=skip_bad, by_ranges=by_ranges
    )


def read_info(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """One row of metadata per `<dataset>.json`, or per line without `multi_line`."""
    return (
        spark.read.schema(INFO_SCHEMA)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select("*", dataset_id(_scanned_file()).alias("dataset_id"))
    )


def scan_reports(
    spark: SparkSession,
    folder: str,
    glob: str = "*.tsv",
    multi_line: bool = True,
    skip_failed: bool = False,
    sep: str = "\t",
) -> tuple[DataFrame, DataFrame]:
    """All files of a folder as one table with `source_filename`, and the table of unreadable files.

    Every file is read to its end once before; one that cannot be (damaged, empty) is an error, or
    left out as a whole and listed with `skip_failed`. Records with too many fields are left out. Files
    are grouped by their header line, because a reader with one schema binds columns by position; the
    groups are then united by column name. A report is named by `dataset_id` and its number.
    """
    headers = materialize(read_headers(spark, folder, glob, whole=True), "headers")
    groups: dict[str, list[str]] = {}
    for r in headers.where("error IS NULL").select("path", "header").toLocalIterator():
        groups.setdefault(r["header"], []).append(r["path"])
    bad = [(r["file_name"], r["error"]) for r in headers.where("error IS NOT NULL").collect()]
    if bad and not skip_failed:
        raise ValueError(f"{len(bad)} files cannot be read, first {bad[0][0]}: {bad[0][1]}")
    failed = small_table(spark, bad, "file_name string, error string")
    if not groups:
        raise ValueError(f"no readable {glob} file in {folder}")
    parts = [
        read_delimited(
            spark, paths, _header_columns(line, sep), sep=sep, multi_line=multi_line, with_source=True, skip_bad=True
        )
        for line, paths in sorted(groups.items())
    ]
    corpus = union_by_name(*parts)
    if "dataset_id" not in corpus.columns:
        corpus = corpus.withColumn("dataset_id", dataset_id(F.col(SOURCE_COLUMN)))
    return corpus, failed


def load_report(corpus: DataFrame, files: DataFrame, failed: DataFrame) -> DataFrame:
    """(file_name, n_rows, error) for every file of the folder, loaded or not."""
    loaded = corpus.groupBy(F.col(SOURCE_COLUMN).alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return (
        files.select("file_name")
        .join(loaded, "file_name", "left")
        .join(failed, "file_name", "left")
        .select("file_name", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "error")
        .orderBy("file_name")
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
    by_ranges: bool = False,
) -> DataFrame:
    """The combined corpus: Parquet, or one CSV layout with quoted multi-line texts.

    With `by_ranges`, one large CSV file is read by many tasks; see `read_delimited`.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    if columns is None:
        columns = spark.read.option("header", True).option("escape", '"').csv(path).columns
    return read_delimited(spark, path, columns, sep=",", multi_line=multi_line, by_ranges=by_ranges)


def read_quadrant(spark: SparkSession, base: str, slug: str | None = None) -> DataFrame:
    """One quadrant of a table written by `write_by_quadrant`, or all; one folder is scanned."""
    df = spark.read.parquet(base)
    return df if slug is None else df.where(F.col("quadrant_slug") == slug)
