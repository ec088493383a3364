"""Packing of documents into token windows by a non-negative fit of length combinations to the histogram.

Whole windows are cut off first; what is left of each document is shorter than a window. The histogram
of these lengths (fewer entries than a window has tokens) goes to the driver. There all combinations
of two or three lengths that fill a window exactly are columns of a non-negative least squares problem;
its solution says how often to use each. Rounded down and kept within the histogram it is the plan; a
greedy pass uses up what the rounding has left, and the rest is laid end to end and cut at window
borders, so only the very last sequence has padding.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions.sizing import broadcast_if_small
from narrascope.llm.bpe import END_ID, default_path, encoder
from narrascope.llm.common import steps, stored, texts

LENGTH = 1024
#: Rounds of the coordinate descent, and moves in each.
FIT_ROUNDS, ROUND_MOVES = 200, 64


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All combinations of two or three of the lengths that fill the window, as rows with 0 for no third."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    out = [(a, window - a, 0) for a in lengths if a <= window - a and has[window - a]]
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[has[window - a - b]]
        out.extend(zip(itertools.repeat(a), b, window - a - b))
    return np.array(out, np.int64).reshape(-1, 3)


def fit(columns: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 with small squared distance between sum(x * column) and the histogram.

    Coordinate descent: a round takes the columns with the steepest gains and moves one after the other
    to its own optimum. A column of three pieces changes three entries of the residual, so a move costs a
    few additions.
    """
    x = np.zeros(len(columns))
    if not len(columns):
        return x
    # Entry 0 stands for "no third piece" and stays 0.
    left = histogram.astype(np.float64).copy()
    left[0] = 0.0
    times = np.stack([(columns == columns[:, [i]]).sum(axis=1) * (columns[:, i] > 0) for i in range(3)], axis=1)
    weight = times.sum(axis=1)  # the squared norm: 1 + 1 + 1, 4 + 1 or 9
    for _ in range(rounds):
        move = np.maximum(left[columns].sum(axis=1) / weight, -x)
        size = np.abs(move) * np.sqrt(weight)
        if size.max() < 0.5:
            break
        for c in np.argpartition(-size, min(ROUND_MOVES, len(size)) - 1)[:ROUND_MOVES]:
            pieces = columns[c][columns[c] > 0]
            step = max(left[pieces].sum() / weight[c], -x[c])
            x[c] += step
            np.subtract.at(left, pieces, step)
    return x


class Plan:
    """Places for the n-th remainder of every length.

    `ranges[r]` holds, in order of the rank, (first rank, first sequence, offset) of each use of the
    length in a combination; ranks from `rest[r][0]` on lie at position `rest[r][1]` and following of
    the stream that is cut at window borders.
    """

    def __init__(self, histogram: np.ndarray, window: int = LENGTH):
        lengths = np.flatnonzero(histogram)
        columns = combinations(lengths, window)
        solution = fit(columns, histogram)
        left = histogram.astype(np.int64).copy()
        used = np.zeros(len(histogram), np.int64)
        ranges: dict[int, list[tuple[int, int, int]]] = {int(r): [] for r in lengths}
        self.sequences = 0
        order = np.argsort(-solution, kind="stable")
        # First the rounded solution, then once more greedily with whatever is left.
        for wanted in (np.floor(solution), np.full(len(columns), np.inf)):
            for c in order:
                pieces = [int(p) for p in columns[c] if p]
                times = min(left[p] // pieces.count(p) for p in pieces)
                times = int(min(times, wanted[c]))
                if times <= 0:
                    continue
                offset = 0
                for p in pieces:
                    ranges[p].append((int(used[p]), self.sequences, offset))
                    used[p] += times
                    left[p] -= times
                    offset += p
                self.sequences += times
        self.ranges = {r: np.array(v, np.int64).reshape(-1, 3) for r, v in ranges.items()}
        self.rest, at = {}, 0
        for r in lengths:
            self.rest[int(r)] = (int(used[r]), at)
            at += int(left[r]) * int(r)
        self.window, self.stream = window, at

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of the remainder with this rank among its length."""
        from_rank, base = self.rest[length]
        if rank < from_rank:
            own = self.ranges[length]
            first, sequence, offset = own[np.searchsorted(own[:, 0], rank, side="right") - 1]
            return [(int(sequence + rank - first), int(offset), length)]
        at = base + (rank - from_rank) * length
        out = []
        while length:
            take = min(length, self.window - at % self.window)
            out.append((self.sequences + at // self.window, at % self.window, take))
            at, length = at + take, length - take
        return out


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """ids of every document, with its remainder and running counts inside its task."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen, full = np.zeros(window, np.int64), 0
        for batch in steps(batches):
            known = encoder(tokenizer)
            end = np.array([end_id], known.dtype).tobytes()
            raws = [known.encode(t) + end for t in batch[1].to_pylist()]
            rows = []
            for raw in raws:
                n = len(raw) // known.dtype.itemsize
                r = n % window
                rows.append((n, r, int(seen[r]), full))
                seen[r] += 1
                full += n // window
            made = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), (), ()))]
            size = pa.array([known.dtype.itemsize] * len(raws), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array([part] * len(raws), pa.int64()), *made, size, pa.array(raws, pa.binary())],
                ["doc_id", "part", "n", "r", "rank", "full", "size", "ids"],
            )

    return docs.mapInArrow(run, "doc_id long, part long, n long, r long, rank long, full long, size long, ids binary")


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = LENGTH,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Texts are encoded once and stored. Ranks inside a length and sequence numbers are sums over the
    counts of the tasks that wrote the ids, so no length, however common, meets in one task. A null or
    empty text is its end id alone; repeated rows and ids are packed like any others; an empty table
    gives no piece.
    """
    tokens = stored(_encoded(texts(docs, id_col, text_col), tokenizer or default_path(), end_id, window), "packing-ids")
    counts = stored(
        tokens.groupBy("part", "r").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.floor(F.col("n") / window)).alias("full_windows")),
        "packing-counts",
    )
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("r").agg(F.sum("docs").alias("docs")).collect():
        histogram[row["r"]] = row["docs"]
    histogram[0] = 0
    plan = Plan(histogram, window)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        "part", "r", F.coalesce(F.sum("docs").over(before.partitionBy("r").orderBy("part")), F.lit(0)).alias("rank_before")
    )
    parts = counts.groupBy("part").agg(F.sum("full_windows").alias("full_windows"))
    parts = parts.select("part", F.coalesce(F.sum("full_windows").over(before.orderBy("part")), F.lit(0)).alias("full_before"))
    whole = int(counts.agg(F.sum("full_windows")).first()[0] or 0)
    joined = tokens.join(broadcast_if_small(ranks), ["part", "r"]).join(broadcast_if_small(parts), "part")

    def cut(batches):
        for batch in steps(batches):
            rows = []
            names = ("doc_id", "n", "r", "rank", "full", "size", "ids", "rank_before", "full_before")
            for key, n, r, rank, full, size, raw, ranks_, fulls in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                ids = np.frombuffer(raw, f"<u{size}").astype("<u4")
                places = [(fulls + full + i, 0, window) for i in range(n // window)]
                if r:
                    places += [(whole + s, o, k) for s, o, k in plan.place(r, ranks_ + rank)]
                start = 0
                for sequence, offset, length in places:
                    rows.append((key, start, length, ids[start : start + length].tobytes(), n, sequence, offset))
                    start += length
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(cut, schema)
