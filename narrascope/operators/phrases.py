"""Which phrases of a text may be in a large dictionary, told inside the row by a Bloom filter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as tx

# Words of the longest phrase, and the bits that hold its length beside the position in a found code.
MAX_WORDS = 3
_LENGTH_BITS = 2
BITS_PER_PHRASE = 12
# The filter travels with every task: 16 MB at most. Beyond some ten million phrases it lets more through,
# and the join that follows still decides.
MAX_BITS = 1 << 27
MAX_HASHES = 7
# The increment and the two multipliers of the published 64-bit splitmix generator.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _flat(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, and where each row ends."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), ends


def _phrases(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts, hashes) of the runs of 1 to `MAX_WORDS` tokens that begin at `start` and stay before `end`."""
    h = _mixed(flat[start])
    for n in range(1, MAX_WORDS + 1):
        yield n, start, h
        if n == MAX_WORDS:
            return
        more = start + n < end
        start, end = start[more], end[more]
        h = _mixed(h[more] * _STEP + flat[start + n])


def _bits(h: np.ndarray, j: int, n_bits: int) -> np.ndarray:
    """The j-th bit of each hash; the stride is odd, so that it reaches every bit."""
    stride = (h >> np.uint64(32)) | np.uint64(1)
    return (h + np.uint64(j) * stride) & np.uint64(n_bits - 1)


def _token_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _masks(n_bits: int, n_hashes: int):
    """Words of the filter that the phrases of a batch set; a phrase is the whole array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            lengths = ends - starts
            hashes = [
                h[np.isin(start, starts[lengths == n])]
                for n, start, h in _phrases(flat, starts[lengths > 0], ends[lengths > 0])
            ]
            h = np.concatenate(hashes)
            bits = np.unique(np.concatenate([_bits(h, j, n_bits) for j in range(n_hashes)]))
            word, first = np.unique(bits >> np.uint64(6), return_index=True)
            masks = np.uint64(1) << (bits & np.uint64(63))
            masks = np.bitwise_or.reduceat(masks, first) if len(first) else masks
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(masks.view(np.int64))], names=["word", "mask"]
            )

    return run


@dataclass(frozen=True)
class PhraseFilter:
    """Bits of a dictionary's phrases. A phrase of the dictionary is always found, some others are too."""

    words: Broadcast
    n_bits: int
    n_hashes: int

    @classmethod
    def build(
        cls, phrases: DataFrame, column: str, bits_per_phrase: float = BITS_PER_PHRASE, max_bits: int = MAX_BITS
    ) -> PhraseFilter:
        """From a column of phrases of up to `MAX_WORDS` words with one blank between them.

        Tasks set the bits of their phrases, one aggregation joins them, and at most `max_bits` of them, a
        power of two fitting the number of phrases, pass through the driver.
        """
        n = max(1, phrases.count())
        n_bits = min(max_bits, max(64, 1 << math.ceil(math.log2(max(1.0, n * bits_per_phrase)))))
        n_hashes = min(MAX_HASHES, max(1, round(math.log(2) * n_bits / n)))
        tokens = phrases.select(_token_hashes(F.split(column, " ")).alias("tokens"))
        masks = tokens.mapInArrow(_masks(n_bits, n_hashes), "word long, mask long")
        table = masks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(n_bits // 64, np.uint64)
        words[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
        return cls(phrases.sparkSession.sparkContext.broadcast(words), n_bits, n_hashes)

    def _codes(self, hashes: Column) -> Column:
        """Where phrases that may be in the dictionary start and how long they are, in text order."""
        words, n_bits, n_hashes = self.words, self.n_bits, self.n_hashes

        @F.arrow_udf("array<int>")
        def found(tokens: pa.Array) -> pa.Array:
            bits = words.value
            flat, ends = _flat(tokens)
            row_end = np.repeat(ends, np.diff(ends, prepend=0))
            codes = []
            for n, start, h in _phrases(flat, np.arange(len(flat)), row_end):
                for j in range(n_hashes):
                    bit = _bits(h, j, n_bits)
                    hit = (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    start, h = start[hit], h[hit]
                codes.append((start << _LENGTH_BITS) | n)
            code = np.sort(np.concatenate(codes))
            row = np.searchsorted(ends, code >> _LENGTH_BITS, side="right")
            begins = ends - np.diff(ends, prepend=0)
            inside = (code - (begins[row] << _LENGTH_BITS)).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(tokens)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(inside))

        # So marked, a later filter on the phrases does not run the function a second time.
        return found.asNondeterministic()(hashes)

    def likely(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        """`df` with an array of the phrases of a text that may be in the dictionary, in text order.

        Only hashes of tokens go to Python, and only phrases that pass are built.
        """
        tokens = df.withColumn("_tokens", tx.tokens(text_col))
        coded = tokens.withColumn("_codes", self._codes(_token_hashes(F.col("_tokens"))))

        def built(row: Column) -> Column:
            length = (1 << _LENGTH_BITS) - 1
            return F.transform(
                row["codes"],
                lambda c: F.array_join(
                    F.slice(row["tokens"], F.shiftright(c, _LENGTH_BITS) + 1, c.bitwiseAND(length)), " "
                ),
            )

        row = F.struct(F.col("_tokens").alias("tokens"), F.col("_codes").alias("codes"))
        return coded.withColumn(out, tx.let(row, built)).drop("_tokens", "_codes")
