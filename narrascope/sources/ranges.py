"""Records of delimited files with quoted line breaks, cut by as many tasks as a file has ranges.

A line break ends a record where the number of quotes before it is even. Lines are read in splits, quotes are
counted per split, and sums over the splits before tell whether a split begins inside a quoted text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrascope.functions.sizing import materialize

# A whole record, and the two parts of one that goes over the end of a range.
_WHOLE, _HEAD, _TAIL = 0, 1, 2
_CUT = "path string, start long, kind int, opens boolean, record string"


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, start, value): lines in file order within a range; only line feeds end a line."""
    return spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _inside(lines: DataFrame) -> dict[str, dict[int, bool]]:
    """For files of several ranges: whether a range begins inside quotes. A few bytes for each range."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("path", "start").agg(F.sum(quotes).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    total, ranges = (f.over(Window.partitionBy("path")) for f in (F.sum("n"), F.count(F.lit(1))))
    told = sums.select("path", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("odd"), total.alias("n"), ranges.alias("k"))
    rows = told.where("k > 1 OR n % 2 = 1").toArrow().to_pylist()
    found: dict[str, dict[int, bool]] = {}
    for r in rows:
        if r["n"] % 2:
            raise ValueError(f"{r['path']}: a quote is not closed; read it with multi_line=True")
        found.setdefault(r["path"], {})[r["start"]] = r["odd"]
    return found


def _cutter(inside: Broadcast):
    """Joins the lines of each range to records; batches continue one another."""

    def emit(path: str, start: int, kinds, opens, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * n, pa.string()),
                pa.array(np.full(n, start, np.int64)),
                pa.array(kinds, pa.int32()),
                pa.array(opens, pa.bool_()),
                records.cast(pa.string()),
            ],
            names=["path", "start", "kind", "opens", "record"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        held: list[pa.Array] = []  # lines of a record that has not ended
        head = odd = False
        header = False  # the first record of a file is still to come

        def close() -> Iterator[pa.RecordBatch]:
            """What the range leaves open: the start of a record, or the middle of a very long one."""
            if at is not None and held:
                if header:
                    raise ValueError(f"{at[0]}: the header is longer than a split")
                text = "\n".join(line for part in held for line in part.to_pylist())
                yield emit(*at, [_HEAD if head else _TAIL], [not head], pa.array([text]))
            held.clear()

        for batch in batches:
            path, start, value = batch.columns
            starts = start.to_numpy()
            names = pc.dictionary_encode(path)
            ids = names.indices.to_numpy()
            edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(ids) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(starts)]):
                if a == b:
                    continue
                here = (names.dictionary[int(ids[a])].as_py(), int(starts[a]))
                if here != at:
                    yield from close()
                    known = inside.value.get(here[0])
                    if known is None and here[1] > 0 or known is not None and here[1] not in known:
                        raise ValueError("the files or the size of their splits have changed since quotes were counted")
                    at, head = here, bool(known and known[here[1]])
                    odd, header = head, here[1] == 0
                lines = value.slice(a, b - a)
                parity = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + odd) % 2
                ends = np.flatnonzero(parity == 0) + 1
                odd = bool(parity[-1])
                if not len(ends):
                    held.append(lines)
                    continue
                first = pa.concat_arrays([*held, lines.slice(0, int(ends[0]))])
                offsets = np.concatenate([[0, len(first)], len(first) + ends[1:] - ends[0]])
                rest = lines.slice(int(ends[0]), int(ends[-1] - ends[0]))
                joined = pa.LargeListArray.from_arrays(
                    pa.array(offsets, pa.int64()), pa.concat_arrays([first, rest]).cast(pa.large_string())
                )
                records = pc.binary_join(joined, pa.scalar("\n", pa.large_string())).slice(int(header))
                kinds = np.full(len(records), _WHOLE)
                if head:
                    kinds[0] = _HEAD
                yield emit(*at, kinds, np.zeros(len(records), bool), records)
                head = header = False
                held[:] = [lines.slice(int(ends[-1]))] if ends[-1] < len(lines) else []
        yield from close()

    return run


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, record) of every record but each file's first, its header; empty records are left out.

    Quotes have to be balanced, doubled where they are meant, and only in quoted fields. A file whose quotes do
    not come out even is refused. Files are read once when called to count quotes, once for the records that go
    over the end of a range (these are stored and put together by a shuffle), and once by each use. Between the
    call and the use neither the files nor the size of splits may change; if ranges differ, the use fails.
    """
    lines = _lines(spark, paths)
    cut = lines.mapInArrow(_cutter(spark.sparkContext.broadcast(_inside(lines))), _CUT)
    parts = materialize(cut.where(F.col("kind") != _WHOLE), "record-parts")

    # A part belongs to the last part before it that begins a record.
    order = Window.partitionBy("path").orderBy("start", "kind")
    began = F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(order)
    owner = parts.select("path", "start", "kind", began.alias("began"))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    mended = (
        parts.join(owner, ["path", "start", "kind"])
        .groupBy("path", "began")
        .agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    )
    whole = cut.where(F.col("kind") == _WHOLE).select("path", "record")
    records = whole.unionByName(mended.select("path", "record"))
    # A line may end with a carriage return before its line feed.
    records = records.withColumn("record", F.regexp_replace("record", "\\r\\z", ""))
    return records.where("record <> ''")
