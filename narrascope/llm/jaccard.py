"""Jaccard join of word n-gram sets with R-trees over group counts.

Two sets of a and b shingles that reach the similarity differ in at most d = (a + b)(1 - t) / (1 + t)
shingles. Shingles are hashed into groups:

* The directory above the trees uses d + 1 groups and more: of so many groups at least one has the same
  content in both sets, so every pair to be found meets in a bucket (group, content of the group). A set
  is put only into the buckets of its d + 1 fullest groups: in the order of fullness those before the first
  common one all differ, in either set, so this one is among them. One
  global tree over the counts would not split anything: the allowed distance of a pair is many times the
  spread of a single count, so that every node of the tree would be visited by every query.
* Inside a bucket the counts per group of every set are a point of an R-tree. The overlap of a set with
  everything below a node is at most the sum of the minima of its counts and the node's largest counts.
  Pairs that survive, and pass the same bound on finer counts, are candidates; what candidates connect
  is a cluster, and a pair to be found never lies in two clusters. Only counts are shuffled for this, and
  of buckets with the same members only one is searched.
* Inside a cluster candidates are found in the same way and verified on the whole sets, unless links
  already connect them.

A cluster is processed in tiles of bounded size which all contain the set closest to its mean point;
pairs across tiles are searched where that leaves a cluster in several pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from narrascope.functions.sizing import broadcast_if_small
from narrascope.llm.common import hashed, mix, ship, signed, steps, stored, texts, utf8, windows
from narrascope.llm.graph import components

#: Groups that are coordinates of a point, sets in a tile, and points in a node of the tree.
DIMENSIONS, TILE, FANOUT = 64, 2048, 32
#: Ratio of the largest to the smallest set size of a directory level.
LEVEL_RATIO = 2
_PERSON = np.uint64(0x5851F42D4C957F2D)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams; a shorter text is one n-gram of all its words."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = hashed(words)
    if len(words) < width:
        return mix(windows(ids, len(words)) + np.uint64(len(words)))
    return np.unique(windows(ids, width))


def set_hash(found: np.ndarray) -> int:
    """A 64-bit name of a set that does not depend on order; 0 only for the empty set."""
    if not len(found):
        return 0
    total = mix(np.array([mix(found ^ _PERSON).sum() + np.uint64(len(found))], np.uint64))
    return int(signed(total)[0]) or 1


def needed(a, b, percent: int):
    """Smallest overlap of sets of a and b elements that reaches the similarity."""
    return -((-percent * (a + b)) // (100 + percent))


def differences(size: int, high: int, percent: int) -> int:
    """Most shingles in which a set can differ from a linked one, where the smaller of the two has at most `high`."""
    return (100 - percent) * (size + (size * 100 // percent if size <= high else high)) // (100 + percent)


def levels(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, groups) of the directory levels up to a size.

    A pair belongs to the level of its smaller set. Sets so small that no difference is allowed are
    only linked to equal ones and stand in no level.
    """
    out, low = [], 1
    while low <= largest:
        if differences(low, low, percent) < 1:
            low += 1
            continue
        high = max(low, math.ceil(low * LEVEL_RATIO) - 1)
        d = differences(high, high, percent)
        # Groups that are empty in both sets say nothing, so there are enough for more filled ones than differences.
        groups = d + 2
        while groups < 2 * d + 3 and any(
            groups - 1 - differences(size, high, percent) < (empty := groups * math.exp(-size / groups)) + 5 * math.sqrt(empty)
            for size in (low, high)
        ):
            groups += 1
        out.append((low, high, groups))
        low = high + 1
    return out


_levels: dict[int, list] = {}


def levels_for(percent: int, size: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """Levels in which a set of this size can meet a partner: its own, and those of smaller partners."""
    known = _levels.setdefault(percent, [])
    if not known or known[-1][1] < size:
        known[:] = levels(percent, 2 * size + 100)
    for i, level in enumerate(known):
        if level[0] <= size <= level[1] * 100 // percent:
            yield i, level


def bucket_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Names of the buckets of a set: in each level those of its fullest groups, one more than may differ.

    Equal groups are equally full and stand in the same order in both sets. Before the first of them there
    are only groups that differ, so it has a bucket in both. Empty groups come last and get a bucket only
    where there are too few others.
    """
    out = []
    for i, (_, high, groups) in levels_for(percent, len(found)):
        group = (mix(found + np.uint64(i)) % np.uint64(groups)).astype(np.int64)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, group, mix(found ^ _PERSON))
        fullest = np.argsort(-np.bincount(group, minlength=groups), kind="stable")
        place = np.arange(groups, dtype=np.uint64) + np.uint64(i << 32)
        out.append(mix(content ^ mix(place))[fullest[: differences(len(found), high, percent) + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def group_counts(found: np.ndarray) -> np.ndarray:
    return np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=DIMENSIONS)


def fine_counts(found: np.ndarray) -> np.ndarray:
    """Counts over more groups for larger sets, so that the bound on the overlap stays sharp; they fold to fewer."""
    groups = DIMENSIONS if len(found) < 512 else 4 * DIMENSIONS if len(found) < 4096 else 16 * DIMENSIONS
    shift = np.uint64(64 - (groups.bit_length() - 1))
    return np.bincount((found >> shift).astype(np.int64), minlength=groups)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(groups, -1).sum(axis=1)


def bounded_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of the minima of two fine counts: no smaller than the overlap."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


class CountTree:
    """A bulk-loaded R-tree over group counts: a node keeps its largest counts and its smallest and largest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        spread = np.argsort(-points.std(axis=0), kind="stable")[:2]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]] // 4, sizes))
        self.levels = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(top) > 1:
            starts = np.arange(0, len(top), FANOUT)
            top = np.maximum.reduceat(top, starts, axis=0)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((top, low, high))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indexes of the points whose bound on the overlap allows a link."""
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            fits = (percent * size <= 100 * high[at]) & (percent * low[at] <= 100 * size)
            at = at[fits]
            at = at[np.minimum(top[at], point).sum(axis=1) >= needed(size, low[at], percent)]
            below = len(self.levels[depth - 1][1]) if depth else len(self.order)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < below]
        at = self.order[at]
        sizes = self.sizes[at]
        fits = (percent * size <= 100 * sizes) & (percent * sizes <= 100 * size)
        at, sizes = at[fits], sizes[fits]
        return at[np.minimum(self.points[at], point).sum(axis=1) >= needed(size, sizes, percent)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) < len(b):
        a, b = b, a
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def link_forest(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified links (as index pairs) that connect every two of the given sets that links connect.

    `known` numbers pieces that are connected already. The sets nearest to the mean point come first and
    candidates with many links are tried first, so a copied original is verified against all its copies,
    which leaves nothing to verify between them.
    """
    if len(sets) < 2:
        return []
    points = np.stack([group_counts(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(points, sizes)
    root, first = list(range(len(sets))), {}
    for i, piece in enumerate(known or ()):
        root[i] = first.setdefault(piece, i)
    pieces = len({find(root, i) for i in root})
    degree, out = np.zeros(len(sets), np.int64), []
    for i in np.argsort(np.abs(points - points.mean(axis=0)).sum(axis=1), kind="stable"):
        if pieces == 1:
            break
        own = find(root, i)
        for j in sorted(tree.near(points[i], sizes[i], percent), key=lambda j: -degree[j]):
            other = find(root, j)
            if other == own or overlap(sets[i], sets[j]) < needed(sizes[i], sizes[j], percent):
                continue
            root[other] = own
            out.append((int(i), int(j)))
            degree[[i, j]] += 1
            pieces -= 1
    return out


def candidate_forest(fine: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that the bounds allow, as far as they connect pieces that earlier pairs do not connect."""
    if len(fine) == 2:
        small, large = sorted(map(int, sizes))
        fits = percent * large <= 100 * small and bounded_overlap(*fine) >= needed(small, large, percent)
        return [(0, 1)] if fits else []
    points = np.stack([folded(f, DIMENSIONS) for f in fine])
    tree, root, out, pieces = CountTree(points, sizes), list(range(len(fine))), [], len(fine)
    for i in range(len(fine)):
        if pieces == 1:
            break
        own = find(root, i)
        for j in tree.near(points[i], sizes[i], percent):
            other = find(root, int(j))
            if other != own and bounded_overlap(fine[i], fine[j]) >= needed(sizes[i], sizes[j], percent):
                root[other] = own
                out.append((i, int(j)))
                pieces -= 1
    return out


def _narrow(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, sid, fine) of every document."""

    def run(batches):
        for batch in steps(batches):
            sets = [shingles(t, width) for t in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch[0],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(map(set_hash, sets), pa.int64()),
                    pa.array([fine_counts(s).astype("<u4").tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "sid", "fine"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, sid long, fine binary")


def _bucket_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, sid) for every bucket of every document."""

    def run(batches):
        for batch in steps(batches):
            keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            seen = set()
            for text in batch[1].to_pylist():
                found = shingles(text, width)
                name = set_hash(found)
                if name and name not in seen:
                    seen.add(name)
                    keys.append(bucket_keys(found, percent))
                    ids.append(np.full(len(keys[-1]), name, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids))], ["key", "sid"]
            )

    return docs.mapInArrow(run, "key long, sid long")


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(cluster, sid, found, counts) from (doc_id, text, cluster, sid)."""

    def run(batches):
        for batch in steps(batches):
            columns = (batch.column(n).to_pylist() for n in ("cluster", "sid", "text"))
            rows = [(c, s, shingles(t, width)) for c, s, t in zip(*columns, strict=True)]
            # Rows that repeat a doc_id with another text have another set.
            rows = [r for r in rows if set_hash(r[2]) == r[1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([signed(r[2]) for r in rows], pa.list_(pa.int64())),
                    pa.array([group_counts(r[2]).astype(np.float64) for r in rows], pa.list_(pa.float64())),
                ],
                ["cluster", "sid", "found", "counts"],
            )

    return docs.mapInArrow(run, "cluster long, sid long, found array<long>, counts array<double>")


def _linked(tiles: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) inside the groups of equal (cluster, tile); `piece` names connected sets, null if none."""

    def flush(rows):
        rows = list({r[0]: r for r in rows}.values())
        ids = [r[0] for r in rows]
        sets = [r[1] for r in rows]
        pieces = [ids[i] if r[2] is None else r[2] for i, r in enumerate(rows)]
        return [(ids[i], ids[j]) for i, j in link_forest(sets, percent, pieces)]

    def run(batches):
        group, rows = None, []
        for batch in batches:
            out = []
            offsets = batch.column("found").offsets.to_numpy()
            values = batch.column("found").values.to_numpy().view(np.uint64)
            columns = [batch.column(n).to_pylist() for n in ("cluster", "tile", "sid", "piece")]
            for i, (cluster, tile, sid, piece) in enumerate(zip(*columns, strict=True)):
                if (cluster, tile) != group:
                    out += flush(rows)
                    group, rows = (cluster, tile), []
                rows.append((sid, values[offsets[i] : offsets[i + 1]].copy(), piece))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = zip(*out, strict=True) if (out := flush(rows)) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = tiles.select("cluster", "tile", "sid", "found", "piece").repartition("cluster", "tile")
    return dealt.sortWithinPartitions("cluster", "tile").mapInArrow(run, "a long, b long")


def _tiled(sets: DataFrame, tile: int) -> DataFrame:
    """`sets` with a tile number and the number of tiles; the set nearest to the mean of a large cluster is in all.

    Only clusters of more than one tile need a mean, which is summed per task before it is shuffled.
    """
    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    large = sizes.where(F.col("members") > tile).withColumn("tiles", F.ceil(F.col("members") / tile).cast("long"))
    own = sets.join(broadcast_if_small(large.select("cluster", "tiles")), "cluster")
    mean = own.groupBy("cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("counts"))).alias("mean"))
    far = F.aggregate(F.zip_with("counts", "mean", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    middle = (
        own.join(mean, "cluster")
        .groupBy("cluster")
        .agg(F.min_by("sid", F.struct(far, F.col("sid"))).alias("middle"))
        .join(large, "cluster")
        .select("cluster", "tiles", "middle")
    )
    middle = broadcast_if_small(stored(middle, "jaccard-middle"))
    return (
        sets.drop("counts")
        .join(middle, "cluster", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        .withColumn("own_tile", F.pmod(F.xxhash64("sid"), "tiles"))
        .withColumn("is_middle", F.coalesce(F.col("sid") == F.col("middle"), F.lit(False)))
        .drop("middle")
    )


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Candidate links (a, b) that connect what the bounds connect inside each bucket of `members`(key, sid, n, fine)."""

    def flush(rows):
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) < 2:
            return []
        fine = [np.frombuffer(r[2], "<u4").astype(np.int64) for r in rows]
        return [(rows[i][0], rows[j][0]) for i, j in candidate_forest(fine, np.array([r[1] for r in rows]), percent)]

    def made(out):
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            out = []
            for key, *row in zip(*(batch.column(n).to_pylist() for n in ("key", "sid", "n", "fine")), strict=True):
                if key != bucket:
                    out += flush(rows)
                    bucket, rows = key, []
                rows.append(row)
            yield made(out)
        yield made(flush(rows))

    dealt = members.select("key", "sid", "n", "fine").repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _meeting(docs: DataFrame, narrow: DataFrame, width: int, percent: int, tile: int) -> DataFrame:
    """Edges (a, b) between sets: whatever they do not connect cannot be linked.

    Buckets with the same members are searched once: they agree in the number of members and in two sums of
    their hashes. A bucket of more than a tile is not searched here; its sets stay together.
    """
    by_key = Window.partitionBy("key")
    sums = [F.sum(F.xxhash64("sid", F.lit(i)) % (1 << 40)).over(by_key).alias(f"sum{i}") for i in range(2)]
    rows = _bucket_rows(docs, width, percent)
    rows = rows.select("key", "sid", F.min("sid").over(by_key).alias("hub"), F.max("sid").over(by_key).alias("top"), F.count("sid").over(by_key).alias("members"), *sums)
    met = stored(rows.where("hub <> top").drop("top"), "jaccard-buckets")
    large = met.where((F.col("members") > tile) & (F.col("hub") != F.col("sid"))).selectExpr("hub a", "sid b")
    small = met.where(F.col("members") <= tile)
    once = small.groupBy("members", "sum0", "sum1").agg(F.min("key").alias("key")).select("key")
    sets = narrow.where("sid <> 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("fine").alias("fine"))
    return large.union(_candidates(small.join(once, "key").join(sets, "sid"), percent))


def similar_sets(docs: DataFrame, *, width: int, percent: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row and (sid, label) of the linked distinct sets, both stored."""
    ship(docs.sparkSession)
    narrow = stored(_narrow(docs, width), "jaccard-documents")
    clusters = components(_meeting(docs, narrow, width, percent, tile), "jaccard-clusters")
    keepers = narrow.where("doc_id is not null and sid <> 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    keepers = keepers.join(clusters.select(F.col("node").alias("sid"), F.col("label").alias("cluster")), "sid")
    keepers = stored(keepers, "jaccard-keepers")
    found = _with_sets(docs.join(broadcast_if_small(keepers), "doc_id"), width)
    sets = _tiled(stored(found, "jaccard-sets"), tile)
    everywhere = F.when(F.col("is_middle"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array("own_tile"))
    first = sets.withColumn("tile", F.explode(everywhere)).withColumn("tile", F.col("tile").cast("string")).withColumn("piece", F.lit(None).cast("long"))
    links = stored(_linked(first, percent), "jaccard-links")
    labels = components(links, "jaccard-labels")
    # Pairs across the tiles of clusters that the first search has left in several pieces.
    pieced = sets.where("tiles > 1").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    pieced = pieced.withColumn("piece", F.coalesce("label", "sid"))
    open_clusters = (
        pieced.groupBy("cluster").agg(F.min("piece").alias("x"), F.max("piece").alias("y")).where("x <> y").select("cluster")
    )
    open_clusters = stored(open_clusters, "jaccard-open")
    if not open_clusters.isEmpty():
        others = F.expr("filter(sequence(0L, tiles - 1), t -> t <> own_tile)")
        pair = F.concat_ws("-", F.least("own_tile", "other"), F.greatest("own_tile", "other"))
        second = pieced.join(broadcast_if_small(open_clusters), "cluster").withColumn("other", F.explode(others))
        more = _linked(second.withColumn("tile", pair), percent)
        labels = components(stored(links.union(more), "jaccard-links"), "jaccard-labels")
    return narrow.drop("fine"), labels.select(F.col("node").alias("sid"), "label")


def _grouped(docs: DataFrame, width: int, percent: int, tile: int) -> DataFrame:
    """(doc_id, n, sid, label, component_id) of every row; rows of one group share the label."""
    narrow, labels = similar_sets(docs, width=width, percent=percent, tile=tile)
    sets = narrow.where("sid <> 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(labels, "sid", "left")
    sets = stored(sets.withColumn("label", F.coalesce("label", "sid")), "jaccard-names")
    names = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    return narrow.join(sets.join(names, "label").select("sid", "label", "component_id"), "sid", "left")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    tile: int = TILE,
) -> DataFrame:
    """Per row: doc_id, n_shingles, and component_id, the smallest doc_id reachable by links.

    Two rows link when 100 x intersection >= `percent` x union of their shingle sets; equal sets always
    link. A null, empty or wordless text has no shingles and is linked with nothing. Repeated rows link
    to each other. Rows with a null doc_id take no part and get a null component. Links between
    different sets that a chain of other links already connects are not listed.
    """
    return _grouped(texts(docs, id_col, text_col), width, percent, tile).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _with_sid(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """`docs` with the set name of the text in the column `_sid`."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in steps(batches):
            names = [set_hash(shingles(t, width)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*batch.schema.names, "_sid"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("_sid", LongType())]))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, without those whose group has a smaller doc_id.

    Rows with a null id stay. Rows that repeat an id are judged by their own text: of those in one group
    one stays, and of those without shingles one. The ids to drop are broadcast if their measured number
    allows it, else joined by a shuffle; texts are only hashed again for repeated ids.
    """
    found = _grouped(texts(docs, id_col, text_col), width, percent, TILE).where("doc_id is not null")
    found = stored(found.withColumn("stays", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))), "jaccard-kept")
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    again = stored(again, "jaccard-repeated")
    own = F.col(id_col).cast("long") == F.col("_id")
    drop = broadcast_if_small(found.where("not stays").select(F.col("doc_id").alias("_id")).distinct())
    if again.isEmpty():
        return docs.join(drop, own, "left_anti")
    once = docs.join(again, own, "left_anti").join(drop, own, "left_anti")
    verdicts = found.join(again, F.col("doc_id") == F.col("_id"), "left_semi")
    verdicts = verdicts.select(F.col("doc_id").alias("_id"), F.col("sid").alias("_sid"), F.coalesce("label", "sid").alias("_label"), "stays").distinct()
    repeated = _with_sid(docs.join(again, own, "left_semi"), text_col, width)
    repeated = repeated.join(verdicts.where("stays").drop("stays"), own & (repeated["_sid"] == verdicts["_sid"])).dropDuplicates(["_id", "_label"])
    return once.unionByName(repeated.select(docs.columns))
