"""Token-id files with keyed access: raw id payloads in shards, found through minimal perfect hash buckets.

A folder holds
  ids/<shard>-<attempt>.bin   raw little-endian unsigned ids of consecutive documents, nothing else
  index/<bucket>-<attempt>.bin  minimal perfect hash, fingerprints, shard numbers, first ids, lengths
  keys, shards, buckets       Parquet tables: the keys in order, and the files of the attempts that count
Tasks write files under names of their own and return the name with their rows, so a task that is run
again leaves an unused file behind and nothing else.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrascope.functions.sizing import broadcast_if_small
from narrascope.llm.bpe import END_ID, default_path, encoder
from narrascope.llm.common import mix, ship, steps, texts

#: Keys of one index bucket, on average.
BUCKET_KEYS = 100_000
GAMMA, MAX_LEVELS = 2.0, 128
_NULL_KEY = np.uint64(0x6A09E667F3BCC908)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def key_hashes(ids: pa.Array, occurrence: np.ndarray) -> np.ndarray:
    """One 64-bit key for (doc_id, occurrence); a null id has a key of its own."""
    plain = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    plain[np.asarray(ids.is_null())] = _NULL_KEY
    return mix(plain ^ mix(occurrence.astype(np.uint64)))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: level after level, a bit for every place hit once.

    A key's number is the count of set bits before its own, so numbers run from 0 to n - 1 and a lookup
    costs a few probes whatever n is.
    """

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.before, total = [], 0
        for level in bits:
            counts = np.bitwise_count(level).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(counts)[:-1]]))
            total += int(counts.sum())
        self.size = total

    @staticmethod
    def place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level], np.uint64))) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits = []
        while len(keys):
            if len(bits) == MAX_LEVELS:
                raise ValueError("keys of an index must be distinct")
            words = max(1, int(np.ceil(GAMMA * len(keys) / 64)))
            place = cls.place(keys, len(bits), words)
            once = np.bincount(place, minlength=64 * words) == 1
            bits.append(np.packbits(once, bitorder="little").view("<u8"))
            keys = keys[~once[place]]
        return cls(bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where no level has a bit (a key that was not built in may get a number)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before, strict=True)):
            place = self.place(keys[left], level, len(bits))
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out


@dataclass
class Bucket:
    """The index of one bucket of keys: where the ids of each key are."""

    hash: PerfectHash
    fingerprint: np.ndarray
    shard: np.ndarray
    first: np.ndarray
    length: np.ndarray

    @staticmethod
    def fingerprints(keys: np.ndarray) -> np.ndarray:
        return (mix(keys + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys, shard, first, length) -> Bucket:
        made = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[made.find(keys)] = np.arange(len(keys))
        return cls(made, cls.fingerprints(keys)[order], shard[order], first[order], length[order])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, levels=np.array([len(b) for b in self.hash.bits]), bits=np.concatenate([np.zeros(0, "<u8"), *self.hash.bits]),
            fingerprint=self.fingerprint, shard=self.shard, first=self.first, length=self.length,
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bucket:
        got = np.load(io.BytesIO(raw))
        bits = np.split(got["bits"], np.cumsum(got["levels"])[:-1]) if len(got["levels"]) else []
        return cls(PerfectHash(bits), *(got[n] for n in ("fingerprint", "shard", "first", "length")))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that is not in the index (up to equal 32-bit fingerprints)."""
        slot = self.hash.find(keys)
        if not len(self.fingerprint):
            return slot
        return np.where((slot >= 0) & (self.fingerprint[slot] == self.fingerprints(keys)), slot, -1)


def write(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    bucket_keys: int = BUCKET_KEYS,
) -> None:
    """Write the ids of every document, an `end_id` after each, in ascending order of the ids' column.

    Texts are dealt by ranges of the key and sorted inside a range, then encoded and appended to the
    range's file as they come; a task never holds more than a batch. A null text is an empty one; null
    keys come first; rows that repeat a key follow each other and are told apart by an occurrence
    number from 0. An empty table gives a folder without payload files.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()

    def shards(batches):
        shard, name = TaskContext.get().partitionId(), None
        out, first, last, occurrence = None, 0, object(), 0
        for batch in steps(batches, 1024):
            if out is None:
                name = f"ids/{shard:06d}-{uuid.uuid4().hex}.bin"
                system, folder = filesystem(path)
                system.create_dir(f"{folder}/ids", recursive=True)
                out = system.open_output_stream(f"{folder}/{name}")
            known = encoder(tokenizer)
            end = np.array([end_id], known.dtype).tobytes()
            firsts, lengths, times = [], [], []
            for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                raw = known.encode(text) + end
                occurrence = occurrence + 1 if key == last else 0
                last = key
                out.write(raw)
                firsts.append(first)
                lengths.append(len(raw) // known.dtype.itemsize)
                times.append(occurrence)
                first += lengths[-1]
            n = batch.num_rows
            columns = [
                batch[0], pa.array(times, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([name] * n, pa.string()),
                pa.array([known.dtype.str] * n, pa.string()), pa.array(firsts, pa.int64()), pa.array(lengths, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "occurrence", "shard", "file", "kind", "first", "length"])
        if out is not None:
            out.close()

    schema = "doc_id long, occurrence long, shard long, file string, kind string, first long, length long"
    dealt = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(shards, schema).write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    entries.groupBy("shard", "file", "kind").agg(F.sum("length").alias("n_ids")).write.parquet(f"{path}/shards")
    buckets = max(1, -(-entries.count() // bucket_keys))
    _with_bucket(entries.select("doc_id", "occurrence"), buckets).write.parquet(f"{path}/keys")

    def index(batches):
        own = _by_bucket(batches)
        for bucket, columns in own:
            made = Bucket.build(*columns)
            system, folder = filesystem(path)
            system.create_dir(f"{folder}/index", recursive=True)
            name = f"index/{bucket:06d}-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(made.to_bytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int64()), pa.array([name]), pa.array([len(columns[0])], pa.int64()), pa.array([buckets], pa.int64())],
                ["bucket", "file", "n_keys", "buckets"],
            )

    located = _with_bucket(entries, buckets).select("bucket", "key", "shard", "first", "length")
    located = located.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    located.mapInArrow(index, "bucket long, file string, n_keys long, buckets long").write.parquet(f"{path}/buckets")


def _with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    """Add the 64-bit key and its bucket."""

    def run(batches):
        for batch in batches:
            found = key_hashes(batch.column("doc_id"), batch.column("occurrence").to_numpy())
            more = [pa.array(found.view(np.int64)), pa.array((found % np.uint64(buckets)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "key", "bucket"])

    kinds = ", ".join(f"{n} {k}" for n, k in keys.dtypes)
    return keys.mapInArrow(run, f"{kinds}, key long, bucket long")


def _by_bucket(batches):
    """(bucket, its columns key, shard, first, length) from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []

    def flush():
        whole = pa.Table.from_batches(held)
        key, shard, first, length = (whole.column(n).to_numpy() for n in ("key", "shard", "first", "length"))
        return held[0].column("bucket")[0].as_py(), (key.view(np.uint64), shard, first, length)

    for batch in batches:
        names = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop == start:
                continue
            if held and held[0].column("bucket")[0].as_py() != names[start]:
                yield flush()
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield flush()


def read(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, occurrence, start (ids of all documents before it), n_tokens and ids (little-endian uint32).

    `keys` (doc_id, occurrence) are those to look up, all of the folder's if not given; a key that is not
    there gives no row. Each key is sent to the task that loads its index bucket, and the place found
    there to the task that reads its shard: only keys and places are shuffled, and a document costs one
    ranged read.
    """
    ship(spark)
    files = spark.read.parquet(f"{path}/buckets")
    if keys is None:
        keys = spark.read.parquet(f"{path}/keys")
    else:
        buckets = files.agg(F.max("buckets")).first()[0] or 1
        keys = _with_bucket(keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("long")), buckets)
    asked = keys.join(broadcast_if_small(files.select("bucket", "file")), "bucket")

    def locate(batches):
        name, loaded = None, None
        for batch in batches:
            files_, found = batch.column("file").to_pylist(), batch.column("key").to_numpy().view(np.uint64)
            places = np.zeros((3, batch.num_rows), np.int64)
            keep = np.zeros(batch.num_rows, bool)
            cuts = [0, *(i for i in range(1, len(files_)) if files_[i] != files_[i - 1]), len(files_)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if stop == start:
                    continue
                if files_[start] != name:
                    name = files_[start]
                    system, folder = filesystem(path)
                    with system.open_input_stream(f"{folder}/{name}") as source:
                        loaded = Bucket.from_bytes(source.read())
                slot = loaded.find(found[start:stop])
                keep[start:stop] = slot >= 0
                for row, column in zip(places, (loaded.shard, loaded.first, loaded.length), strict=True):
                    row[start:stop] = column[slot]
            made = [batch.column("doc_id"), batch.column("occurrence"), *map(pa.array, places)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "occurrence", "shard", "first", "length"]).filter(pa.array(keep))

    placed = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        locate, "doc_id long, occurrence long, shard long, first long, length long"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{path}/shards").withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = placed.join(broadcast_if_small(shards.drop("n_ids")), "shard")

    def payload(batches):
        name, source = None, None
        for batch in steps(batches, 1024):
            columns = [batch.column(n).to_pylist() for n in ("file", "kind", "first", "length")]
            raws = []
            for file, kind, first, length in zip(*columns, strict=True):
                if file != name:
                    system, folder = filesystem(path)
                    name, source = file, system.open_input_file(f"{folder}/{file}")
                size = np.dtype(kind).itemsize
                raws.append(np.frombuffer(source.read_at(length * size, first * size), kind).astype("<u4").tobytes())
            start = batch.column("before").to_numpy() + batch.column("first").to_numpy()
            made = [batch.column("doc_id"), batch.column("occurrence"), pa.array(start), batch.column("length"), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "occurrence", "start", "n_tokens", "ids"])

    dealt = placed.repartition("shard").sortWithinPartitions("shard", "first")
    return dealt.mapInArrow(payload, "doc_id long, occurrence long, start long, n_tokens long, ids binary")
