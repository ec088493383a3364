"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k on their ratio."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.sizing import broadcast_if_small
from narrascope.llm.common import hashed, mix, ship, steps, stored, utf8, windows

BUCKETS = 1 << 21
#: Pseudo counts that pull the ratio of a bucket to one where the text is thin.
PRIOR = 8.0
#: First sums of a block of counts, each over its share of the tasks.
SALTS = 64
#: Candidates that the last step of the selection may look at on the driver.
SELECT_ROWS = 20_000


def buckets_of(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of the words and word pairs (lower-cased A-Z, stripped of punctuation at the ends)."""
    words = [w.strip(b".,;:!?\"'()[]") for w in utf8(text).lower().split()]
    ids = hashed([w for w in words if w])
    both = np.concatenate([mix(ids), windows(ids, 2)])
    return (both % np.uint64(buckets)).astype(np.int64)


def _counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Feature counts of all texts, and of the target texts: two rows of fixed size, added up by block."""
    block = buckets // 64

    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in steps(batches):
            for text, target in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                found, times = np.unique(buckets_of(text, buckets), return_counts=True)
                total[0, found] += times
                if target:
                    total[1, found] += times
        for i in range(64):
            part = total[:, i * block : (i + 1) * block]
            if part.any():
                raw = zlib.compress(part.tobytes(), 1)
                salt = TaskContext.get().partitionId() % SALTS
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([salt], pa.int64()), pa.array([raw], pa.binary())], names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            raw = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([0], pa.int64()), pa.array([raw], pa.binary())], names)

    names, schema = ["block", "salt", "raw"], "block long, salt long, raw binary"
    out = np.zeros((2, buckets), np.int64)
    first = docs.select("text", "target").mapInArrow(count, schema).repartition("block", "salt").mapInArrow(add, schema)
    for r in first.repartition("block").mapInArrow(add, schema).collect():
        out[:, r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(r["raw"]), np.int64).reshape(2, block)
    return out


def log_weight(counts: np.ndarray, totals: tuple[int, int], found: np.ndarray, target: bool, prior: float = PRIOR) -> float:
    """log(p_target / p_raw) of a document's buckets, from the counts of all other documents.

    Its own counts are left out of both models, or a thin bucket would only tell whether its document is
    itself one of the target.
    """
    own, times = np.unique(found, return_counts=True)
    raw, aim = counts[0, own] - times, counts[1, own] - times * target
    share = (totals[1] - len(found) * target) / max(1, totals[0] - len(found))
    return float((times * np.log((aim + prior) / (raw * share + prior))).sum())


def kth_largest(keys: DataFrame, k: int, limit: int = SELECT_ROWS, weight: str | None = None) -> float:
    """The k-th largest value of column `key`, exactly, by counting in ever narrower ranges.

    With a column `weight` a row stands for so many equal ones.
    """
    if k <= 0:
        return float("inf")
    keys = keys.where("key is not null").select("key", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    size = [F.count("key").alias("n_rows"), F.sum("w").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")]
    n_rows, n, low, high = keys.agg(*size).first()
    if (n or 0) <= k:
        return float("-inf")
    above = 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if low == high:
            return low
        if n_rows <= limit:
            for r in sorted(inside.collect(), reverse=True):
                above += r["w"]
                if above >= k:
                    return r["key"]
        width = (high - low) / 1024
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(1023))
        cells = inside.groupBy(cell.alias("cell")).agg(*size)
        for r in cells.orderBy(F.desc("cell")).collect():
            if above + r["n"] >= k:
                low, high, n_rows = r["low"], r["high"], r["n_rows"]
                break
            above += r["n"]


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    keep: float | None = None,
    seed: int = 1,
) -> DataFrame:
    """Per document: doc_id, n_features, log_weight, key (log weight plus Gumbel noise), kept.

    Target are the documents labelled quality 1 and not toxic, raw are all; the counts of both cover
    every text, and a document is weighed by those of the others. The `keep` share (by default the share of the target among the labelled) with the largest
    keys is kept: a sample without replacement in proportion to the weights. The noise is a hash of id
    and seed. Rows that tie with the last one are all kept. A null or empty text has weight one; without
    labels all weights are one and all rows are kept. Repeated rows give one row each.
    """
    ship(docs.sparkSession)
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target")
    ).where("doc_id is not null and target is not null")
    marks = marks.groupBy("doc_id").agg(F.min("target").alias("target"))
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_labels, n_target = marks.agg(F.count("*"), F.sum(F.col("target").cast("long"))).first()
    targets = marks.where("target")
    marked = _with_target(wanted, targets)
    counts = _counts(marked, buckets)
    totals = (int(counts[0].sum()), int(counts[1].sum()))
    # Of fixed size: two numbers a bucket.
    sent = docs.sparkSession.sparkContext.broadcast(counts if counts.max(initial=0) >> 31 else counts.astype(np.int32))

    def run(batches):
        for batch in batches:
            found = [buckets_of(t, buckets) for t in batch.column("text").to_pylist()]
            aims = batch.column("target").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([log_weight(sent.value, totals, f, t) for f, t in zip(found, aims, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_features", "log_weight"],
            )

    # A number in (0, 1) from 52 bits of the hash.
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12) + F.lit(0.5)) / float(1 << 52)
    keys = marked.mapInArrow(run, "doc_id long, n_features long, log_weight double")
    keys = stored(keys.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "importance-keys")
    share = keep if keep is not None else (n_target or 0) / n_labels if n_labels else 1.0
    limit = kth_largest(keys, round(share * keys.count()))
    return keys.withColumn("kept", F.col("key") >= F.lit(limit))


def _with_target(docs: DataFrame, targets: DataFrame) -> DataFrame:
    marked = docs.join(broadcast_if_small(targets), "doc_id", "left")
    return marked.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
