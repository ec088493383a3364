"""Product codes of vectors: integer k-means on every part, with the points of a task kept in cover trees.

Vectors are cut into parts, and each task puts its vectors, a block at a time, into one cover tree per
part. A node of a tree is a point, a radius that covers all points below it, and a range of the points in
tree order; sums over any range come from cumulative sums. In a round of Lloyd's algorithm a node whose
whole ball is nearer to one codebook entry than to any other is assigned at once, with its sums. The other
nodes open their children, down to single points, which are compared exactly. All arithmetic that decides
anything is on integers, so the codes do not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.sizing import broadcast_if_small
from narrascope.llm.common import ship, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one block, and points up to which a node's children are single points.
BLOCK, FEW = 2048, 8
#: Partial sums of one codebook entry go through so many first sums.
SALTS = 64
#: Largest component after scaling, so that squared distances fit 64 bits.
LARGEST = 1 << 26
_FIELDS = {
    "points": "<i4", "weights": "<i4", "place": "<i4", "centre": "<i4", "radius": "<f8",
    "low": "<i4", "high": "<i4", "first": "<i4", "last": "<i4",
}


def exact(points: np.ndarray) -> np.ndarray:
    """Points as doubles where every squared distance is exact in them, else as 64-bit integers."""
    largest = int(np.abs(points).max(initial=0))
    return points.astype(np.float64 if 4 * points.shape[1] * largest * largest < 1 << 52 else np.int64)


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries, both of the type that `exact` gives."""
    if points.dtype != book.dtype:
        points, book = points.astype(np.int64), book.astype(np.int64)
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ book.T) + (book * book).sum(axis=1)[None]


@dataclass
class CoverTree:
    """Distinct points in tree order, nodes in breadth-first order; the children of a node follow each other."""

    points: np.ndarray  # distinct points in tree order
    weights: np.ndarray  # how often each occurs
    place: np.ndarray  # of every row, the position of its point
    centre: np.ndarray  # position of a node's point
    radius: np.ndarray  # of a node: no point below is farther from its point
    low: np.ndarray  # range of points below a node
    high: np.ndarray
    first: np.ndarray  # range of a node's children
    last: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> CoverTree:
        """Top-down: the children of a node are picked at least half its radius apart and cover its points within that."""
        points, place, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        real = points.astype(np.float64)
        order = np.arange(len(points))
        nodes = [[0, len(points), 0, 0.0, 0, 0]]  # low, high, point, radius, first child, last child
        far = np.sqrt(((real - real[0]) ** 2).sum(axis=1))
        away = [far]  # distances of the points of a node, in order, to its point
        at = 0
        while at < len(nodes):
            low, high, point = nodes[at][:3]
            left, to = order[low:high], away[at]
            away[at] = None
            radius = nodes[at][3] = float(to.max(initial=0.0))
            if radius > 0:
                nodes[at][4] = len(nodes)
                start, parts = low, []
                while len(left):
                    near = to <= radius / 2 if len(left) > FEW or high - low > FEW else to == 0
                    inside, found = left[near], to[near]
                    nodes.append([start, start + len(inside), point, 0.0, 0, 0])
                    parts.append(inside)
                    away.append(found)
                    start += len(inside)
                    left = left[~near]
                    if len(left):
                        point = left[0]
                        apart = real[left] - real[point]
                        to = np.sqrt((apart * apart).sum(axis=1))
                nodes[at][5] = len(nodes)
                order[low:high] = np.concatenate(parts)
            at += 1
        table = np.array([[n[0], n[1], n[2], n[4], n[5]] for n in nodes], np.int64)
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        return cls(
            points[order], weights[order], position[place.ravel()], position[table[:, 2]],
            np.array([n[3] for n in nodes]), table[:, 0], table[:, 1], table[:, 3], table[:, 4],
        )

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in _FIELDS.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], length: int) -> CoverTree:
        out = cls(**{name: np.frombuffer(row[name], kind) for name, kind in _FIELDS.items()})
        out.points = out.points.reshape(-1, length)
        return out

    def settled(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, entries): nodes all of whose points have that nearest entry, ties to the lower index.

        The points of a node lie within its radius of its centre, so if the second nearest entry is
        farther from the centre than the nearest by more than twice the radius, every point below has the
        same nearest entry, and has it alone. The bound leaves room for rounding; single points are exact.
        """
        points, open_ = exact(self.points), np.zeros(1, np.int64)
        book = exact(book)
        while len(open_):
            d = squared(points[self.centre[open_]], book)
            rows = np.arange(len(open_))
            near = d.argmin(axis=1)
            best = np.sqrt(d[rows, near].astype(np.float64))
            d = d.astype(np.float64)
            d[rows, near] = np.inf
            second = np.sqrt(d.min(axis=1))
            radius = self.radius[open_]
            whole = (radius == 0) | (second - best > 2 * radius + 1e-9 * (1 + second))
            whole |= np.isinf(second)
            yield open_[whole], near[whole]
            inner = open_[~whole]
            many = self.last[inner] - self.first[inner]
            skipped = np.repeat(self.first[inner] - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64) if len(inner) else many, many)
            open_ = skipped + np.arange(len(skipped))

    def sums(self, book: np.ndarray) -> np.ndarray:
        """(count, sums of the components) of the points of every entry."""
        rows = np.column_stack([np.ones(len(self.points), np.int64), self.points.astype(np.int64)]) * self.weights[:, None].astype(np.int64)
        below = np.zeros((len(rows) + 1, rows.shape[1]), np.int64)
        np.cumsum(rows, axis=0, out=below[1:])
        out = np.zeros((len(book), rows.shape[1]), np.int64)
        for nodes, entries in self.settled(book):
            np.add.at(out, entries, below[self.high[nodes]] - below[self.low[nodes]])
        return out

    def entries(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row."""
        entry = np.zeros(len(self.points), np.int64)
        for nodes, found in self.settled(book):
            many = self.high[nodes] - self.low[nodes]
            start = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64) if len(nodes) else many
            entry[np.repeat(self.low[nodes] - start, many) + np.arange(many.sum())] = np.repeat(found, many)
        apart = self.points.astype(np.int64) - np.asarray(book, np.int64)[entry]
        return entry[self.place], (apart * apart).sum(axis=1)[self.place]


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    found = np.floor(values.astype(np.float64) * scale)
    if np.abs(found).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}")
    return found.astype(np.int64)


_TREES = pa.list_(pa.struct([(name, pa.binary()) for name in _FIELDS]))
_BLOCKS = "ids array<long>, labels array<string>, length int, trees array<struct<" + ",".join(f"{n}:binary" for n in _FIELDS) + ">>"


def _blocks(kept: DataFrame, parts: int, scale: int, block: int) -> DataFrame:
    """One row for each block of a task's vectors: ids, labels, and a cover tree per part."""

    def made(ids, labels, vectors):
        rows = scaled(np.stack(vectors), scale)
        length = rows.shape[1] // parts
        if length * parts != rows.shape[1] or not length:
            raise ValueError(f"vectors of {rows.shape[1]} components have no {parts} equal parts")
        trees = [CoverTree.of(rows[:, p * length : (p + 1) * length]).packed() for p in range(parts)]
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([length], pa.int32()), pa.array([trees], _TREES)], ["ids", "labels", "length", "trees"])

    def run(batches):
        ids, labels, vectors = [], [], []
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                some = batch.slice(start, block)
                offsets, values = some.column(2).offsets.to_numpy(), some.column(2).values.to_numpy()
                ids += some.column(0).to_pylist()
                labels += some.column(1).to_pylist()
                vectors += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                if len({len(v) for v in vectors}) > 1:
                    raise ValueError("vectors of different lengths")
                while len(ids) >= block:
                    yield made(ids[:block], labels[:block], vectors[:block])
                    ids, labels, vectors = ids[block:], labels[block:], vectors[block:]
        if ids:
            yield made(ids, labels, vectors)

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, _BLOCKS)


def _opened(row: dict, part: int, books: list[np.ndarray]) -> CoverTree:
    if row["length"] != books[part].shape[1]:
        raise ValueError("vectors of different lengths")
    return CoverTree.unpacked(row["trees"][part], row["length"])


def _moved(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round. A task hands on one row per part, entry and position; so does the driver get."""

    def run(batches):
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                for part, book in enumerate(books):
                    total[part] += _opened(row, part, books).sums(book)
        salt = TaskContext.get().partitionId() % SALTS
        for part, found in enumerate(total):
            entry, place = np.nonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), salt), pa.int32()), pa.array(np.full(len(entry), part), pa.int32()),
                 pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(found[entry, place])],
                ["salt", "part", "entry", "place", "total"],
            )

    rows = blocks.select("length", "trees").mapInArrow(run, "salt int, part int, entry int, place int, total long")
    keys = ["part", "entry", "place"]
    rows = rows.groupBy("salt", *keys).agg(F.sum("total").alias("total")).groupBy(*keys).agg(F.sum("total").alias("total"))
    sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for r in rows.collect():
        sums[r["part"]][r["entry"], r["place"]] = r["total"]
    used = [s[:, :1] > 0 for s in sums]
    return [np.where(u, s[:, 1:] // np.maximum(s[:, :1], 1), b) for u, s, b in zip(used, sums, books, strict=True)]


def _scored(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = [_opened(row, part, books).entries(book) for part, book in enumerate(books)]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
                width = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                     pa.array([code[i : i + width] for i in range(0, len(code), width)], pa.string()), pa.array(sum(f[1] for f in found), pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def _seeds(kept: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """First codebooks: the parts of the vectors with the smallest ids."""
    ids = [r[0] for r in kept.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    first = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("v")).collect()
    rows = [np.asarray(r["v"], np.float64) for r in sorted(first)]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return np.split(scaled(np.stack(rows), scale), parts, axis=1) if rows else []


def fit(kept: DataFrame, blocks: DataFrame, *, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    books = _seeds(kept, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = _moved(blocks, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block: int = BLOCK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the final codebook of each part.

    Vectors that are null or hold a null or non-finite component are dropped. The codebooks start from
    the smallest ids; of rows that repeat an id the smallest vector counts there, and every row gets a
    code. Fewer ids than entries give smaller codebooks, rows without an id get codes but seed nothing;
    if no row has an id, code and error are null. An empty table has no output. Vectors of different or
    indivisible lengths, and components beyond `LARGEST` after scaling, are errors. At most 256 entries.

    The trees are built once and stored; each round reads them. Vectors are not shuffled. The driver
    holds the codebooks, whose size is given by the parameters.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    ship(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wanted = vectors.where(v.isNotNull() & finite)
    kept = wanted.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("embedding"))
    blocks = stored(_blocks(kept, parts, scale, block), "codes-trees")
    books = fit(kept, blocks, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books:
        return _scored(blocks, books), books
    return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with the error summed over all rows of the same label, null labels together."""
    codes = stored(codes, "codes")
    totals = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(broadcast_if_small(totals), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
