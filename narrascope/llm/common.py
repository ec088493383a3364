"""Shared by the operators: shipping the package, stored intermediate tables, hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions.sizing import scratch_path, short_batches

_shipped: set[str] = set()
#: Rows of one step inside an Arrow batch, so that arrays over all words of a step stay small.
STEP_ROWS = 256
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that caches live in the workers."""
    short_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="narrascope-ship-"), "narrascope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table; other columns do not matter, whatever their names."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def steps(batches: Iterable[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    del batches
    hand_back()


def hand_back() -> None:
    """Give freed memory back to the system: a reused worker would keep it for tasks that do not need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: Words longer than this are never kept by a cache, and bytes that an entry takes besides its own.
LONGEST, ENTRY = 64, 200
_caches: list[Kept] = []
_working_on: list[str] = []


class Kept(dict):
    """Values of words met early in a worker's life, which frequent words are, in a bounded number of bytes.

    Words beyond `LONGEST` characters are not kept, so no text can fill it with few words. When it is
    full, later words are worked out without being kept; after `patience` times as many of these as it
    holds everything is forgotten, in case the texts have changed.
    """

    def __init__(self, limit: int, patience: int = 8):
        super().__init__()
        self.limit, self.patience, self.used, self.beyond = limit, patience, 0, 0
        _caches.append(self)

    def keep(self, word, value, size: int = 0) -> None:
        """Keep a value of `size` bytes of its own if there is room."""
        cost = ENTRY + len(word) + size
        if len(word) > LONGEST or size > 16 * LONGEST:
            return
        if self.used + cost <= self.limit:
            self[word] = value
            self.used += cost
        else:
            self.beyond += 1
            if self.beyond > self.patience * len(self):
                self.clear()

    def clear(self) -> None:
        super().clear()
        self.used = self.beyond = 0


def working_on(operator: str) -> None:
    """What a reused worker has kept for another kind of work is forgotten; called by whatever fills a cache."""
    if _working_on != [operator]:
        _working_on[:] = [operator]
        for cache in _caches:
            cache.clear()
        hand_back()


class WordHashes(Kept):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self.keep(word, value)
        return value


HASHES = WordHashes(48 << 20)


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Two different words agree with probability 2**-64."""
    working_on("words")
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of `width` words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        out = mix(out ^ words[i : len(words) - width + 1 + i])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
