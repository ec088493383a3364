"""Which tokens of one tokenizer belong to which of another, over whole documents.

A text is encoded by a byte-level tokenizer (A) and by a piece model (B). Offsets where tokens of both end
cut them into groups. Most groups are one token of each, of the same bytes: an array computed once maps an
A id to the B id of its bytes, and such groups are counted in a vector as long as A's vocabulary, of which
a task hands on one row per id. Only the links of the other, irregular groups enter a shuffle of id pairs.

Neither tokenizer merges across the blank before a word, so a word is encoded and aligned once per worker
and looked up afterwards; texts that cannot be cut go to both libraries as a whole.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm import bpe, piece_counts
from narrascope.llm.common import Kept, ship, steps, stored, texts, working_on

#: Pairs that make up at least one in so many links are looked up in the tasks; there are no more of them than this.
OFTEN = 1 << 17
#: Distinct pairs that a task holds before it hands their counts on.
FLUSH = 1 << 20


def a_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens stand for their string."""
    letters = {c: b for b, c in enumerate(bpe._byte_letters())}
    out = [b""] * tokenizer.get_vocab_size()
    for shown, i in tokenizer.get_vocab().items():
        out[i] = bytes(letters[c] for c in shown) if all(c in letters for c in shown) else shown.encode()
    return out


def b_bytes(model) -> list[bytes]:
    """The bytes of every id of a piece model; control pieces have none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


def identity(a: list[bytes], b: list[bytes], byte_piece) -> np.ndarray:
    """Of every A id the B id of the same bytes, a piece before a single byte, or -1."""
    known: dict[bytes, int] = {}
    for i in sorted(range(len(b)), key=lambda i: (byte_piece(i), i)):
        if b[i]:
            known.setdefault(b[i], i)
    return np.array([known.get(x, -1) for x in a], np.int64)


class Aligner:
    """Aligns words and texts; words are kept up to `limit` bytes."""

    def __init__(self, a_path: str, b_path: str, limit: int = 160 << 20):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = bpe.Encoder(a_path, limit=0, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a, self.bytes_b = a_bytes(self.a.tokenizer), b_bytes(self.b)
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.same = identity(self.bytes_a, self.bytes_b, self.b.is_byte)
        self.same_list = self.same.tolist()
        self.blank = self.b.piece_to_id("▁")
        self.spelled = all(self._spells(self.b.encode(c), b" " + c.encode()) for c in bpe.CUT_CHARACTERS)
        self.words = AlignedWords(self, limit)
        pieces = piece_counts.vocabulary(b_path)
        self.cuts = (
            self.a.cuts
            and self.spelled
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
            and self.b.encode("a\nb", out_type=str) == self.b.encode("a", out_type=str) + self.b.encode("\nb", out_type=str)[1:]
        )

    def aligned(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[str]]:
        """(A ids of identity groups, links of irregular groups as A id << 32 | B id, groups as text)."""
        same, links, shown = [], [], []
        size_a, size_b = self.size_a, self.size_b
        j = end_a = end_b = from_a = from_b = 0
        for i, x in enumerate(a, 1):
            end_a += size_a[x]
            while end_b < end_a:
                end_b += size_b[b[j]]
                j += 1
            if end_a == end_b:
                y = b[j - 1]
                if i - from_a == 1 and j - from_b == 1:
                    shown.append(f"{x}|{y}")
                    if self.same_list[x] == y:
                        same.append(x)
                    else:
                        links.append(x << 32 | y)
                else:
                    links.append(x << 32 | y)
                    shown.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
                from_a, from_b = i, j
        return same, links, shown

    def _spells(self, b: list[int], raw: bytes) -> bool:
        return b"".join([self.bytes_b[y] for y in b]) == raw

    def _pair(self, a: list[int], b: list[int]) -> tuple[bytes, bytes, str, int]:
        same, links, shown = self.aligned(a, b)
        return array("I", same).tobytes(), array("Q", links).tobytes(), ";".join(shown), len(a) | len(b) << 32

    def word(self, word: str) -> tuple[bytes, bytes, str, int]:
        """A word with the blank before it, or with the line break that it starts with.

        Texts that can be cut hold only characters that both tokenizers spell as they are.
        """
        b = self.b.encode(word)
        return self._pair(self.a.known.ids(word), b[1:] if word[:1] == "\n" else b)

    def text(self, text: str | None) -> tuple[bytes, bytes, str, int]:
        """Identity groups, links, groups as text, and numbers of tokens; empty if the bytes differ."""
        if not text:
            return b"", b"", "", 0
        if self.cuts and text[0] != " " and self.a.can_cut(text):
            found = list(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
            same, links, shown, many = zip(*found, strict=True)
            return b"".join(same), b"".join(links), ";".join(shown), sum(many)
        a, b, raw = self.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode()
        if b"".join([self.bytes_a[x] for x in a]) != raw or not self._spells(b, raw):
            return b"", b"", "", 0
        return self._pair(a, b)


class AlignedWords(Kept):
    def __init__(self, aligner: Aligner, limit: int):
        super().__init__(limit, patience=2)
        self.aligner = aligner

    def __missing__(self, word: str):
        value = self.aligner.word(word)
        # Four objects more than an entry of the other caches has.
        self.keep(word, value, 200 + sum(map(len, value[:3])))
        return value


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    working_on("alignment")
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, counts and digest of every document, with its identity groups and irregular links."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in steps(batches):
            known = aligner(a_path, b_path)
            found = [known.text(t) for t in batch[1].to_pylist()]
            same, links, shown, many = zip(*found, strict=True) if found else ((), (), (), ())
            n_a = np.array([m & 0xFFFFFFFF for m in many], np.int64)
            columns = [
                np.arange(row, row + batch.num_rows),
                n_a,
                np.array([m >> 32 for m in many], np.int64),
                np.array([len(s) // 4 + len(x) // 8 for s, x in zip(same, links, strict=True)], np.int64),
            ]
            row += batch.num_rows
            digests = [hashlib.sha256(s.encode()).hexdigest() if n else "" for s, n in zip(shown, n_a.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch[0], *map(pa.array, columns), pa.array(digests, pa.string()), pa.array(same, pa.binary()), pa.array(links, pa.binary())],
                ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256", "same", "links"],
            )

    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, same binary, links binary"
    return docs.mapInArrow(run, schema)


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    times = np.concatenate([p[1] for p in parts]) if parts else keys
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, times)
    return found, out


def _pair_rows(aligned: DataFrame, same: np.ndarray) -> DataFrame:
    """(pair, regular, n) summed inside every task: a vocabulary-length vector, and the irregular pairs met."""

    def rows(keys, times, regular):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.full(len(keys), regular)), pa.array(times)], ["pair", "regular", "n"]
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        vector, parts, held = np.zeros(len(same), np.int64), [], 0
        for batch in batches:
            vector += np.bincount(_flat(batch[0], "=u4"), minlength=len(same))
            parts.append(np.unique(_flat(batch[1], "=u8"), return_counts=True))
            held += len(parts[-1][0])
            if held > FLUSH:
                keys, times = _summed(parts)
                parts, held = [(keys, times)], len(keys)
                if held > FLUSH // 2:
                    yield rows(keys, times, False)
                    parts, held = [], 0
        yield rows(*_summed(parts), False)
        used = np.flatnonzero(vector)
        yield rows(used << 32 | same[used], vector[used], True)

    return aligned.select("same", "links").mapInArrow(run, "pair long, regular boolean, n long")


class Counts:
    """What a task needs to look up: counts of identity groups and of frequent pairs, and each B id's best count."""

    def __init__(self, same: np.ndarray, best: np.ndarray, regular, often):
        self.same, self.best = same, best
        self.regular = np.zeros(len(same), np.int64)
        self.regular[regular[0] >> 32] = regular[1]
        self.is_best = (self.regular > 0) & (self.regular == best[same])
        order = np.argsort(often[0])
        self.pairs, self.times = often[0][order], often[1][order]
        self.pair_best = self.times == best[self.pairs & 0xFFFFFFFF]

    def look_up(self, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of frequent pairs among the links, which links are frequent)."""
        at = np.searchsorted(self.pairs, links)
        at[at == len(self.pairs)] = 0
        return at, (self.pairs[at] == links) if len(self.pairs) else np.zeros(len(links), bool)


def _columns(df: DataFrame) -> tuple[np.ndarray, ...]:
    found = df.toArrow()
    return tuple(np.asarray(found.column(i).to_numpy(), np.int64) for i in range(found.num_columns))


def _counts(spark: SparkSession, pairs: DataFrame, same: np.ndarray, b_ids: int) -> Counts:
    """Collects one row per B id, one per A id, and at most `OFTEN` pairs."""
    best = np.zeros(b_ids, np.int64)
    ids, times = _columns(pairs.groupBy(F.expr("pair & 4294967295L").alias("b")).agg(F.max("n").alias("n")))
    best[ids] = times
    total = pairs.where("not regular").agg(F.sum("n")).first()[0] or 0
    often = pairs.where(~F.col("regular") & (F.col("n") * OFTEN >= total)).select("pair", "n")
    return Counts(same, best, _columns(pairs.where("regular").select("pair", "n")), _columns(often))


def _looked_up(aligned: DataFrame, counts) -> DataFrame:
    """row, n_best, count_sum of every document over identity groups and frequent pairs."""

    def run(batches):
        known = counts.value
        for batch in batches:
            best, total = [], []
            for same, links in zip(batch.column("same").to_pylist(), batch.column("links").to_pylist(), strict=True):
                ids = np.frombuffer(same, "=u4")
                at, hit = known.look_up(np.frombuffer(links, "=u8").astype(np.int64))
                best.append(int(known.is_best[ids].sum()) + int(known.pair_best[at[hit]].sum()))
                total.append(int(known.regular[ids].sum()) + int(known.times[at[hit]].sum()))
            names = ["doc_id", "row", "n_a", "n_b", "n_groups", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*names, "n_best", "count_sum"]
            )

    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(run, schema)


def _rare_links(aligned: DataFrame, counts) -> DataFrame:
    """(row, pair, times) of the pairs that are not frequent."""

    def run(batches):
        known = counts.value
        for batch in batches:
            rows, pairs, times = [], [], []
            for row, links in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist(), strict=True):
                keys = np.frombuffer(links, "=u8").astype(np.int64)
                keys, n = np.unique(keys[~known.look_up(keys)[1]], return_counts=True)
                rows.append(np.full(len(keys), row))
                pairs.append(keys)
                times.append(n)
            made = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, pairs, times)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, made)), ["row", "pair", "times"])

    return aligned.select("row", "links").mapInArrow(run, "row long, pair long, times long")


def align(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a blank and the text, B the text, which puts that blank before it; strings of special
    tokens are text. A link is a pair of tokens that end together, which is the last pair of a group and no
    other, so there are as many links as groups. n_best counts links whose id pair has its B id's
    highest corpus-wide count, count_sum adds up the corpus-wide counts of all links. A null or empty
    text, and one whose tokens do not spell a blank and the text, has no tokens: zeros and an empty
    digest. Repeated rows and ids give one row each, an empty table none.

    Texts are encoded once; ids and links are stored. Pairs that make up a `OFTEN`th of all irregular
    links or more are broadcast, at most `OFTEN` of them, as are vectors of vocabulary length. The
    other links meet their counts in a shuffle by pair, where no pair has more than a `OFTEN`th of them.
    """
    spark = docs.sparkSession
    ship(spark)
    a_path, b_path = a_path or bpe.default_path(), b_path or piece_counts.default_path()
    aligned = stored(_documents(texts(docs, id_col, text_col), a_path, b_path), "align-documents")
    own = Aligner(a_path, b_path, limit=0)
    same, b_ids = own.same, len(own.bytes_b)
    rows = _pair_rows(aligned, same)
    pairs = stored(rows.groupBy("pair").agg(F.first("regular").alias("regular"), F.sum("n").alias("n")), "align-pairs")
    known = _counts(spark, pairs, same, b_ids)
    best = spark.createDataFrame(pa.table({"b": np.arange(b_ids), "best": known.best}))
    shared = spark.sparkContext.broadcast(known)
    rare = pairs.where(~F.col("regular")).withColumn("b", F.expr("pair & 4294967295L")).join(F.broadcast(best), "b")
    rare = rare.select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    links = _rare_links(aligned, shared).join(rare, "pair")
    sums = links.groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    out = _looked_up(aligned, shared).join(sums, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
