"""Class-based bigram language model: exchange clustering, class transitions, word emissions.

The probability of a text is the product over its tokens (words, then an end mark) of
P(class | class before) x P(word | class). Every count comes from all training documents. Words are
ranked by their counts:

* the first `EXCHANGE` words are clustered by the exchange algorithm on their bigram matrix, whose size
  is fixed, so the driver can hold it;
* every other word seen twice or more makes one exchange move, from no class to its best one: its counts
  of neighbour classes are summed by a shuffle and the class is chosen in a task;
* words seen once stand for the unseen ones and share a class.

The first `HEAD` words travel to the tasks as one table of fixed size. The classes and counts of further
words are joined: a document sends each of its distinct words beyond the head once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import HASHES, hashed, signed, steps, stored, texts, utf8
from narrascope.llm.importance import kth_largest

HEAD, EXCHANGE, CLASSES, SWEEPS = 262_144, 2_048, 64, 4
#: Weight of the class's own frequency in a transition.
ALPHA = 5.0
#: No word holds a line break, so the end mark cannot be mistaken for one.
END = np.uint64(HASHES[b"\n"])
FOLDS, HELD_OUT = 7, 2
_BLOCK = 64
#: Neighbours that a task holds before it sums and sends them, words of one step of moves.
_NEIGHBOURS, _MOVES = 2_000_000, 512


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words, lower-cased A-Z, and of the end mark."""
    return np.append(hashed(utf8(text).lower().split()), END)


@dataclass
class Head:
    """The most frequent words: sorted hashes, their ranks, and counts and classes by rank."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def find(self, words: np.ndarray) -> np.ndarray:
        """The rank of every word, -1 for those beyond the head."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(self.hashes.searchsorted(words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ranks[at], -1)


def _training(batches):
    """Token hashes of the training documents of a step, end marks included."""
    for batch in steps(batches):
        kept = [t for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) if not is_held_out(d)]
        if kept:
            yield np.concatenate([tokens(t) for t in kept])


def _with_start(words: np.ndarray) -> np.ndarray:
    """Every text follows an end mark."""
    return np.concatenate([[END], words])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents; a task sums before it sends."""

    def flush(held):
        found, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(times)], ["word", "n"])

    def run(batches):
        held, size = [], 0
        for words in _training(batches):
            held.append(words)
            size += len(words)
            if size > 6_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _block_sums(docs: DataFrame, rows: int, columns: int, cells: Callable) -> DataFrame:
    """(block, sums) of a matrix of fixed size, `_BLOCK` rows each, added up over all rows of `docs`.

    `cells(batches)` gives row and column numbers to count. A task adds up its own matrix first.
    """
    blocks = -(-rows // _BLOCK)

    def count(batches):
        total = np.zeros(blocks * _BLOCK * columns, np.int32)
        for row, column in cells(batches):
            cell, times = np.unique(row * columns + column, return_counts=True)
            total[cell] += times.astype(np.int32)
        for i, part in enumerate(total.reshape(blocks, -1)):
            if part.any():
                raw = zlib.compress(part.astype("<i4").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([raw], pa.binary())], ["block", "raw"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), "<i4").astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "raw"])

    schema = "block long, raw binary"
    return docs.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)


def _matrix(blocks: DataFrame, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((-(-rows // _BLOCK) * _BLOCK, columns), np.int64)
    for r in blocks.collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["raw"], np.int64).reshape(_BLOCK, columns)
    return out[:rows]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(joint: np.ndarray, total: np.ndarray, out: np.ndarray, into: np.ndarray, own: float, n: float) -> np.ndarray:
    """Change of the log likelihood (up to a constant) if a word that is in no class joins each class.

    `joint` and `total` are class counts without the word; `out` and `into` its counts with each class
    after and before it, `own` those with itself, `n` its total count.
    """
    after = (xlogx(joint + out) - xlogx(joint)).sum(axis=1)
    before = (xlogx(joint.T + into) - xlogx(joint.T)).sum(axis=1)
    corner = joint.diagonal()
    both = xlogx(corner + out + into + own) - xlogx(corner + out) - xlogx(corner + into) + xlogx(corner)
    return after + before + both - 2 * (xlogx(total + n) - xlogx(total))


def exchange(bigrams: np.ndarray, fixed: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words from their square bigram matrix; words with `fixed` >= 0 keep that class.

    Every sweep takes each word out of its class and puts it where the likelihood of the class bigrams
    gains most; it ends early when nothing moves.
    """
    n = len(bigrams)
    total_classes = max(classes, int(fixed.max(initial=-1)) + 1)
    own = np.where(fixed >= 0, fixed, np.arange(n) % classes)
    one_hot = np.zeros((n, total_classes))
    one_hot[np.arange(n), own] = 1
    joint = one_hot.T @ bigrams @ one_hot
    counts = (bigrams.sum(axis=1) + bigrams.sum(axis=0)) / 2.0
    total = np.bincount(own, weights=counts, minlength=total_classes)
    for _ in range(sweeps):
        moved = 0
        for w in np.flatnonzero(fixed < 0):
            row, column, self_ = bigrams[w].astype(float), bigrams[:, w].astype(float), float(bigrams[w, w])
            row[w] = column[w] = 0
            out = np.bincount(own, weights=row, minlength=total_classes)
            into = np.bincount(own, weights=column, minlength=total_classes)
            a = own[w]
            joint[a] -= out
            joint[:, a] -= into
            joint[a, a] -= self_
            total[a] -= counts[w]
            gain = gains(joint, total, out, into, self_, counts[w])[:classes]
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            own[w] = b
            joint[b] += out
            joint[:, b] += into
            joint[b, b] += self_
            total[b] += counts[w]
        if not moved:
            break
    return own


def _packed(words: np.ndarray, codes: np.ndarray, width: int):
    """(word, near) batches: the distinct words with their counted codes, as code * 2**32 + count."""
    found, where = np.unique(words, return_inverse=True)
    cell, times = np.unique(where * width + codes, return_counts=True)
    near = (cell % width).astype(np.uint64) << np.uint64(32) | times.astype(np.uint64)
    ends = np.append(0, np.cumsum(np.bincount(cell // width, minlength=len(found))))
    for a in range(0, len(found), 65_536):
        b = min(a + 65_536, len(found))
        offsets = ((ends[a : b + 1] - ends[a]) * 8).astype(np.int32)
        raw = pa.BinaryArray.from_buffers(
            pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(near[ends[a] : ends[b]].tobytes())]
        )
        yield pa.RecordBatch.from_arrays([pa.array(signed(found[a:b])), raw], ["word", "near"])


def _neighbours(docs: DataFrame, inner: Head, of: np.ndarray, width: int) -> DataFrame:
    """(word, near) of all words that are not in `inner`: class after it, `width` + class before it, or
    2 x `width` for the word itself, with counts. `of` has the classes by rank, the last for other words."""

    def run(batches):
        held, size = [], 0
        for plain in _training(batches):
            words = _with_start(plain)
            found = inner.find(words)
            near, mine = of[found], found < 0
            same = words[1:] == words[:-1]
            after, before = mine[:-1], mine[1:] & ~same
            held.append((words[:-1][after], np.where(same, 2 * width, near[1:])[after]))
            held.append((words[1:][before], width + near[:-1][before]))
            size += int(after.sum() + before.sum())
            if size > _NEIGHBOURS:
                yield from _packed(*map(np.concatenate, zip(*held, strict=True)), 2 * width + 1)
                held, size = [], 0
        if size:
            yield from _packed(*map(np.concatenate, zip(*held, strict=True)), 2 * width + 1)

    return docs.mapInArrow(run, "word long, near binary")


def moves(joint: np.ndarray, near: np.ndarray, classes: int) -> np.ndarray:
    """The best of the first `classes` classes for each word whose counts are now in the last class.

    A row of `near` counts the classes after the word, those before it, and the word after itself. The gain
    is that of `gains` without the word in its class; only classes met next to a word are computed.
    """
    width = len(joint)
    last = width - 1
    out, into, own = near[:, :width], near[:, width : 2 * width], near[:, 2 * width :]

    def side(links, counts, others):
        """Links from a candidate to classes met (rows of `links`); those to the last class lose `others`."""
        sums = np.zeros((len(counts), classes))
        row, column = np.nonzero(counts[:, :last])
        if len(row):
            start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            known = links[column]
            sums[row[start]] = np.add.reduceat(xlogx(known + counts[row, column][:, None]) - xlogx(links)[column], start)
        left = links[last] - others[:, :classes]
        return sums + xlogx(left + counts[:, last:]) - xlogx(left)

    total = (joint.sum(axis=1) + joint.sum(axis=0))[:classes] / 2
    corner = joint.diagonal()[:classes]
    a, b = out[:, :classes], into[:, :classes]
    both = xlogx(corner + a + b + own) - xlogx(corner + a) - xlogx(corner + b) + xlogx(corner)
    n = ((out + into).sum(axis=1) / 2)[:, None] + own
    gain = side(joint[:classes].T, out, into) + side(joint[:, :classes], into, out) + both
    return np.argmax(gain - 2 * (xlogx(total + n) - xlogx(total)), axis=1)


def _moved(near: DataFrame, joint: np.ndarray, classes: int) -> DataFrame:
    """(word, n, class) of all words in `near`; words seen once get the last class, the end mark its own."""
    wide = 2 * len(joint) + 1
    end_word = int(signed(np.array([END]))[0])

    def chosen(words, sums):
        # The last end mark of a step has nothing after it, every word has something before it.
        n = (sums[:, len(joint) :].sum(axis=1)).astype(np.int64)
        own = np.full(len(words), len(joint) - 1)
        often = np.flatnonzero(n > 1)
        for i in range(0, len(often), _MOVES):
            part = often[i : i + _MOVES]
            own[part] = moves(joint, sums[part], classes)
        own[(words == end_word) & (n > 1)] = classes
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(own)], ["word", "n", "class"])

    def run(batches):
        held, kept = np.zeros(0, np.int64), np.zeros((0, wide))
        for batch in batches:
            for start in range(0, batch.num_rows, 8_192):
                part = batch.slice(start, 8_192)
                raws = part[1].to_pylist()
                words = np.append(held, part[0].to_numpy())
                found, where = np.unique(words, return_inverse=True)
                code = np.frombuffer(b"".join(raws), np.uint64)
                row = np.repeat(where[len(held) :], [len(r) // 8 for r in raws])
                cell = row * wide + (code >> np.uint64(32)).astype(np.int64)
                times = (code & np.uint64(0xFFFFFFFF)).astype(float)
                sums = np.bincount(cell, weights=times, minlength=len(found) * wide).reshape(-1, wide)
                sums[where[: len(held)]] += kept
                # Rows come sorted, so only the last word can go on.
                yield chosen(found[:-1], sums[:-1])
                held, kept = found[-1:], sums[-1:]
        if len(held):
            yield chosen(held, kept)

    return near.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, n long, class long")


@dataclass
class Model:
    """What scoring needs, all of fixed size: head words, class transitions, totals. `rows` are the documents."""

    head: Head
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class, head) of the head words
    inside: np.ndarray  # log10 P(head | class)
    in_class: np.ndarray  # tokens of each class
    train_tokens: int
    train_words: int
    rare: int  # class of all words seen once or never
    rare_total: float  # tokens and words seen once, and one for unknown words
    end: int  # class of the end mark
    rows: DataFrame | None = None


def train(
    docs: DataFrame, counts: DataFrame, *, head: int, swapped: int, classes: int, sweeps: int, assigned: int | None = None
) -> Model:
    """Fit the model on the training documents of (doc_id, text) with their word counts.

    `assigned` is accepted for older callers and bounds nothing: every word seen twice makes its move.
    """
    n_tokens, n_words, n_often, often = (
        int(x or 0) for x in counts.agg(F.sum("n"), F.count("n"), F.count_if(F.col("n") > 1), F.sum(F.when(F.col("n") > 1, F.col("n")))).first()
    )
    # The head ends before the count that would exceed its size; the count is found without sorting.
    common = counts.where("n > 1")
    least = kth_largest(common.select(F.col("n").cast("double").alias("key")), head)
    top = common.where(F.col("n") > F.lit(least)).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    known = Head(hashes[order], order.astype(np.int64), top["n"].to_numpy(np.int64))
    size = len(known.counts)
    # Classes: the clusters, the end mark, and the words seen once; the last holds all others until they move.
    end_class, rare, width = classes, classes + 1, classes + 2
    known.classes = np.full(size, rare)
    inner = min(swapped, size)
    first = np.sort(hashes[:inner])
    within = Head(first, known.find(first), known.counts[:inner])
    end = int(within.find(np.array([END]))[0])

    def pairs(batches):
        for words in _training(batches):
            found = within.find(_with_start(words))
            inside = np.where(found >= 0, found, inner)
            yield inside[:-1], inside[1:]

    bigrams = _matrix(_block_sums(docs, inner + 1, inner + 1, pairs), inner + 1, inner + 1)
    fixed = np.full(inner + 1, -1)
    fixed[inner] = rare
    if end >= 0:
        fixed[end] = end_class
    of = exchange(bigrams, fixed, classes, sweeps)
    one_hot = np.zeros((inner + 1, width))
    one_hot[np.arange(inner + 1), of] = 1
    joint = one_hot.T @ bigrams @ one_hot
    known.classes[:inner] = of[:inner]
    words = stored(_moved(_neighbours(docs, within, of, width), joint, classes), "lm-classes")
    # Head words beyond the clusters bring their classes along; sums per class are all the rest needs.
    moved = words.where(F.col("n") > F.lit(least)).where("n > 1").select("word", "class").toPandas()
    at = known.find(moved["word"].to_numpy(np.int64).view(np.uint64))
    known.classes[at[at >= 0]] = moved["class"].to_numpy(np.int64)[at >= 0]
    in_class = np.bincount(of[:inner], weights=known.counts[:inner], minlength=width)
    for r in words.where("n > 1").groupBy("class").agg(F.sum("n").alias("n")).collect():
        in_class[r["class"]] += r["n"]
    in_head = np.bincount(known.classes, weights=known.counts, minlength=width)
    emission = np.log10(known.counts / in_head[known.classes]) if size else np.zeros(0)
    inside = np.log10(np.maximum(in_head, 1) / np.maximum(in_class, 1))
    rare_total = float(n_tokens - often + n_words - n_often + 1)
    model = Model(
        known, np.zeros((width, width)), emission, inside, in_class, n_tokens, n_words, rare, rare_total,
        end_class if int(known.find(np.array([END]))[0]) >= 0 else rare,
    )
    far = words.where(F.col("n") <= F.lit(least)) if np.isfinite(least) else words.where("n = 1")
    # An end mark beyond the head is the one word whose class is asked for before the join.
    mark = far.where((F.col("word") == F.lit(int(signed(np.array([END]))[0]))) & (F.col("n") > 1)).count()
    model.end = start = end_class if mark else model.end
    model.rows = stored(_sequences(docs, far, model), "lm-rows")

    def steps_of(batches):
        for batch in batches:
            for raw in batch[0].to_pylist():
                own = np.frombuffer(raw, "<i2").astype(np.int64)
                yield np.append(start, own[:-1]), own

    seen = model.rows.where("not held_out").select("own")
    joint = _matrix(_block_sums(seen, width, width, steps_of), width, width).astype(float)
    into = joint.sum(axis=0)
    prior = (into + 1) / (into.sum() + width)
    model.transition = np.log10((joint + ALPHA * prior) / (joint.sum(axis=1, keepdims=True) + ALPHA))
    return model


def _sequences(docs: DataFrame, far: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base, emitted, own: every document as classes of its tokens.

    The head decides in the first pass; the distinct words beyond it are joined to `far` (word, n, class).
    """
    head = model.head
    logs = np.log10(head.counts + 1.0)
    emitted = model.emission + model.inside[head.classes] if len(head.counts) else model.emission
    in_class = np.log10(np.maximum(model.in_class, 1))
    rare, rare_log = model.rare, float(np.log10(model.rare_total))

    def one(doc_id, text):
        words = tokens(text)
        found = head.find(words)
        known = found[found >= 0]
        rest, where = np.unique(words[found < 0], return_inverse=True)
        own = np.empty(len(words), "<i4")
        own[found >= 0] = head.classes[known]
        own[found < 0] = -1 - where
        return doc_id, is_held_out(doc_id), len(known), float(logs[known].sum()), float(emitted[known].sum()), own.tobytes(), signed(rest)

    def first(batches):
        row = TaskContext.get().partitionId() << 40
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()))
        for batch in steps(batches):
            made = [one(d, t) for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)]
            columns = zip(*made, strict=True) if made else [()] * len(kinds)
            rows = pa.array(range(row, row + len(made)), pa.int64())
            row += len(made)
            yield pa.RecordBatch.from_arrays(
                [rows, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["row", "doc_id", "held_out", "n_head", "base", "emitted", "own", "far"],
            )

    def second(batches):
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "emitted", "own"]
        for batch in batches:
            doc_id, held_out, n_head, base, given, raws, n_far, found = batch.columns
            offsets = found.offsets.to_numpy()
            at, n, cls = (found.values.field(i).to_numpy() for i in range(3))
            made = []
            for i, (raw, size) in enumerate(zip(raws.to_pylist(), n_far.to_pylist(), strict=True)):
                own = np.frombuffer(raw, "<i4").astype(np.int64)
                mine = slice(offsets[i], offsets[i + 1])
                times = np.zeros(size, np.int64)
                classes = np.full(size, rare)
                times[at[mine]], classes[at[mine]] = n[mine], cls[mine]
                where = -1 - own[own < 0]
                own[own < 0] = classes[where]
                log = np.log10(times + 1.0)
                # Words seen once and unknown ones share a class by their counts plus one.
                word = np.where(classes == rare, log - rare_log, np.log10(np.maximum(times, 1)) - in_class[classes])
                made.append((len(own), int((times > 0)[where].sum()), float(log[where].sum()), float(word[where].sum()), own.astype("<i2").tobytes()))
            n_tokens, n_known, logs_, words_, own = zip(*made, strict=True) if made else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id, held_out, pa.array(n_tokens, pa.int64()),
                    pa.array(n_head.to_numpy() + np.array(n_known, np.int64)),
                    pa.array(base.to_numpy() + np.array(logs_, float)),
                    pa.array(given.to_numpy() + np.array(words_, float)),
                    pa.array(own, pa.binary()),
                ],
                names,
            )

    schema = "row long, doc_id long, held_out boolean, n_head long, base double, emitted double, own binary, far array<long>"
    rows = stored(docs.mapInArrow(first, schema), "lm-first")
    rest = rows.select("row", F.posexplode("far").alias("at", "word"))
    found = rest.join(far, "word").groupBy("row").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "n", "class")).alias("found"))
    none = F.array().cast("array<struct<at:long,n:long,class:long>>")
    ready = rows.withColumn("n_far", F.size("far")).drop("far").join(found, "row", "left").withColumn("found", F.coalesce("found", none))
    ready = ready.select("doc_id", "held_out", "n_head", "base", "emitted", "own", "n_far", "found")
    return ready.mapInArrow(second, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, own binary")


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    head: int = HEAD,
    assigned: int | None = None,
    swapped: int = EXCHANGE,
    classes: int = CLASSES,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Trained on the documents whose crc32(doc_id as text) mod 7 is not 2. base_score is the add-one
    unigram log10 probability, score the class model's. A null or empty text is its end mark alone; a
    null id counts as empty text in the fold; repeated rows give one row each; a table without training
    documents makes every token unknown.
    """
    docs = texts(docs, id_col, text_col)
    counts = stored(word_counts(docs), "lm-counts")
    model = train(docs, counts, head=head, assigned=assigned, swapped=swapped, classes=classes, sweeps=sweeps)
    transition, start = model.transition, model.end

    def run(batches):
        for batch in batches:
            made = []
            for raw, emitted in zip(batch[6].to_pylist(), batch[5].to_pylist(), strict=True):
                own = np.frombuffer(raw, "<i2").astype(np.int64)
                made.append(emitted + float(transition[np.append(start, own[:-1]), own].sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(made, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
            )

    scored = model.rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    space = float(np.log10(model.train_tokens + model.train_words + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(space)).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
