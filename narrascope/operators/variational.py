"""Topics by batch variational inference: every iteration reads every report once.

The topics are a (term, topic) matrix of at most `max_terms` x k numbers, so its size follows from two
parameters and it may travel with the tasks. A task infers the topics of its reports from sparse counts and
adds up one matrix of the same size; the matrices are summed in two steps. Nothing that grows with the
number of reports reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import dealt_out, materialize, short_batches, small_table
from narrascope.operators import topics
from narrascope.operators.stats import drop_null_text

_MERGE_SALTS = 32
# Reports are inferred in blocks of about this many (report, term, topic) cells, or one report.
_BLOCK_CELLS = 300_000
# A report goes on to the next stage of the inference when at most this share of the topics is left in it.
_STAGES = (0.5, 0.2, 0.1)
# Reports and (report, term) cells that a task infers together, so that later stages still have large blocks.
_POOL_REPORTS, _POOL_CELLS = 4_096, 1_000_000
# The sums of a pass are taken from blocks of about this many (report, term) cells, or one report.
_SUM_CELLS = 8_000
# A topic that gives every term of a report less than this share changes no sum of doubles.
_NEGLIGIBLE = 1e-25
# The arrays of a block are packed anew when at most this share of their reports or topics is still needed.
_REPACK = 0.6
_FEATURES = "ids array<int>, counts array<double>"
_SHIFT = 8
_TINY = np.finfo(np.float64).tiny


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log gamma function for positive arguments."""
    y = x + 6
    inverse = 1 / (y * y)
    tail = 1 / 252 - inverse * (1 / 240 - inverse * (1 / 132 - inverse * (691 / 32760)))
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * tail))
    q = x * (x + 5)  # 1/x + ... + 1/(x + 5), taken from both ends
    return np.log(y) - 0.5 / y - series - (x + y - 1) * (1 / q + 1 / (q + 4) + 1 / (q + 6))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) without the logarithm, in few passes over the array."""
    y = x + 6
    inverse = 1 / y
    square = inverse * inverse
    power = square * (691 / 32760)
    for c in (-1 / 132, 1 / 240, -1 / 252, 1 / 120, -1 / 12):
        power += c
        power *= square
    inverse *= 0.5
    power -= inverse
    q = x + 5
    q *= x  # (2x + 5) (1/q + 1/(q + 4) + 1/(q + 6)) is 1/x + ... + 1/(x + 5)
    part = 3 * q
    part += 20
    part *= q
    part += 24
    under = q + 10
    under *= q
    under += 24
    under *= q
    part /= under
    np.add(x, y, out=under)
    under -= 1
    part *= under
    power -= part
    np.exp(power, out=power)
    power *= y
    return power


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive arguments."""
    y = x + _SHIFT
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - sum(np.log(x + i) for i in range(_SHIFT))


def expected_log(parameters: np.ndarray) -> np.ndarray:
    """Expected logarithms under a Dirichlet distribution per row."""
    return digamma(parameters) - digamma(parameters.sum(axis=-1, keepdims=True))


def _dirichlet_gap(prior: float, parameters: np.ndarray, expected: np.ndarray, others: int = 0) -> float:
    """Expected log prior minus expected log posterior, summed over rows; `others` more parameters are the prior."""
    n, width = parameters.shape
    at_prior = float(log_gamma(np.array(prior)))
    whole = float(log_gamma(np.array((width + others) * prior))) - width * at_prior
    fit = (log_gamma(parameters.sum(axis=1) + others * prior) - log_gamma(parameters).sum(axis=1)).sum()
    return n * whole - float(fit) + float(((prior - parameters) * expected).sum())


@dataclass(frozen=True)
class _Inference:
    """What a task needs to infer the topics of a report."""

    beta: np.ndarray  # exp of the expected log weights, (term, topic)
    prior: float
    steps: int
    tolerance: float

    def blocks(self, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """(rows, terms, counts, topic parameters) of reports of similar length; padded cells count zero."""
        lengths = np.diff(offsets)
        gamma = self.parameters(offsets, ids, counts)
        left = _by_length(lengths, np.flatnonzero(lengths))
        while len(left):
            rows, left = np.split(left, [max(1, _SUM_CELLS // lengths[left[0]])])
            yield rows, *_padded(rows, offsets, ids, counts), gamma[rows]

    def _least(self, terms: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        """The least mixture of a term beside which topics with the prior as parameter are negligible."""
        at_prior = float(np.exp(digamma(np.array(self.prior))))
        return np.where(cnt > 0, (self.beta.max(axis=1) * (at_prior / _NEGLIGIBLE))[terms], 0.0)

    def parameters(self, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Topic parameters of all reports; the prior for those without terms.

        A report stops moving when its parameters change by less than the tolerance on average, so its
        result does not depend on the reports beside it. Most topics of a report soon have the prior as
        parameter, to the last digit, and are left out of the products. Reports differ in how many are left,
        so they pass through stages, and in each are put together anew with those of similar length.
        """
        k, lengths = self.beta.shape[1], np.diff(offsets)
        left = np.flatnonzero(lengths)
        gamma, alive, taken = np.full((len(lengths), k), self.prior), np.full(len(lengths), k), np.zeros(len(lengths), dtype=int)
        gamma[left] = 1.0
        for stage, floor in enumerate((*(share * k for share in _STAGES), -1)):
            left, later = _by_length(lengths, left), []
            while len(left) and self.steps:
                width = lengths[left[0]]
                rows = left[: max(1, _BLOCK_CELLS // width)]
                rows, left = np.split(left, [max(1, _BLOCK_CELLS // (width * max(1, alive[rows].max())))])
                later.append(self._advance(rows, *_padded(rows, offsets, ids, counts), gamma, alive, taken, floor, stage == 0))
            left = np.concatenate(later) if later else left
        return gamma

    def _advance(
        self, rows: np.ndarray, terms: np.ndarray, cnt: np.ndarray, found: np.ndarray, alive: np.ndarray,
        taken: np.ndarray, floor: float, first: bool,
    ) -> np.ndarray:
        """Steps of the reports of a block, until they stop or at most `floor` topics are above the prior.

        Parameters, topics above the prior and steps taken are put into `found`, `alive` and `taken`; the reports
        that still move are returned. Topics come back if the mixture of a term gets so low that they would count.
        """
        k, gamma, topics, later = self.beta.shape[1], found[rows], None, []
        if first:
            beta = self.beta.take(terms, axis=0)  # (report, term, topic) with all topics, else (report, topic, term)
        else:
            topics = np.argsort(-gamma, axis=1, kind="stable")[:, : max(1, alive[rows].max())]
            gamma = np.take_along_axis(gamma, topics, 1)
            beta = self._turned.take(topics[:, :, None] * np.int64(len(self.beta)) + terms[:, None, :])
        least, steps, moving = self._least(terms, cnt), taken[rows], np.ones(len(rows), dtype=bool)
        while len(rows):
            theta = exp_digamma(gamma)  # a common factor cancels out
            turned = beta.swapaxes(1, 2) if topics is None else beta
            mixed = np.matmul(theta[:, None, :], turned)[:, 0, :]
            if topics is not None and (mixed < least).any():
                gamma, topics, beta = self._spread(gamma, topics), None, self.beta.take(terms, axis=0)
                continue
            mixed += _TINY
            new = np.matmul(turned, np.divide(cnt, mixed, out=mixed)[:, :, None])[:, :, 0]
            new *= theta
            new += self.prior
            change = new - gamma
            np.copyto(gamma, new, where=moving[:, None])
            steps += moving
            moving &= (np.abs(change, out=change) @ np.ones(change.shape[1]) > self.tolerance * k) & (steps < self.steps)
            live = (gamma > self.prior).sum(axis=1)
            stay = moving & (live > floor)
            if stay.sum() <= _REPACK * len(rows):
                gone = ~stay
                found[rows[gone]] = self._spread(gamma[gone], None if topics is None else topics[gone])
                alive[rows[gone]], taken[rows[gone]] = live[gone], steps[gone]
                later.append(rows[gone & moving])
                rows, gamma, beta, terms, cnt, least, steps, live = (
                    x[stay] for x in (rows, gamma, beta, terms, cnt, least, steps, live)
                )
                topics, moving = None if topics is None else topics[stay], moving[stay]
            if topics is not None and len(rows) and live.max() <= _REPACK * gamma.shape[1]:
                best = np.argsort(-gamma, axis=1, kind="stable")[:, : max(1, live.max())]
                gamma, topics = np.take_along_axis(gamma, best, 1), np.take_along_axis(topics, best, 1)
                beta = beta[np.arange(len(rows))[:, None], best]
        return np.concatenate(later)

    @cached_property
    def _turned(self) -> np.ndarray:
        """The matrix topic by topic, flat."""
        return self.beta.T.ravel()

    def _cells(self, terms: np.ndarray, topics: np.ndarray) -> np.ndarray:
        """Positions of (report, term, topic) in the flat matrix."""
        return terms[:, :, None] * np.int64(self.beta.shape[1]) + topics[:, None, :]

    def _spread(self, gamma: np.ndarray, topics: np.ndarray | None) -> np.ndarray:
        """Parameters of all topics from those of some."""
        if topics is None:
            return gamma
        full = np.full((len(gamma), self.beta.shape[1]), self.prior)
        np.put_along_axis(full, topics, gamma, 1)
        return full

    def weights(self, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Topic shares per report; a report without known terms has equal shares."""
        gamma = self.parameters(offsets, ids, counts)
        return gamma / gamma.sum(axis=1, keepdims=True)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per task: the (term, topic) statistics and, as last entry, the reports' part of the bound."""
        total, bound, seen, k = np.zeros(self.beta.shape), 0.0, False, self.beta.shape[1]
        for pool in _pooled(batches):
            seen = seen or len(pool[0]) > 1
            for _, terms, cnt, gamma in self.blocks(*pool):
                whole = digamma(gamma.sum(axis=1, keepdims=True))
                # As in the inference, topics at the prior are left out where they are negligible.
                alive = int((gamma > self.prior).sum(axis=1).max())
                least = self._least(terms, cnt) * np.exp(-whole)
                for n in (alive, k):
                    topics = np.argsort(-gamma, axis=1, kind="stable")[:, :n]
                    cells, top = self._cells(terms, topics), np.take_along_axis(gamma, topics, 1)
                    expected = digamma(top) - whole
                    theta = np.exp(expected)
                    mixed = np.matmul(self.beta.reshape(-1).take(cells), theta[:, :, None])[:, :, 0]
                    if not (mixed < least).any():
                        break
                mixed += _TINY
                bound += _dirichlet_gap(self.prior, top, expected, k - n) + float((cnt * np.log(mixed)).sum())
                np.add.at(total.reshape(-1), cells.ravel(), ((cnt / mixed)[:, :, None] * theta[:, None, :]).ravel())
        if seen:
            stats = np.append((total * self.beta).ravel(), bound)
            salt = TaskContext.get().partitionId() % _MERGE_SALTS
            yield pa.RecordBatch.from_pydict(
                {"salt": pa.array([salt], pa.int32()), "stats": pa.array([stats], pa.list_(pa.float64()))}
            )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column, from the first row on."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Offsets, term numbers and counts of several batches of (ids, counts) together."""
    held: list[tuple[np.ndarray, ...]] = []

    def together() -> tuple[np.ndarray, ...]:
        lengths, ids, counts = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return np.concatenate([[0], np.cumsum(lengths)]), ids, counts

    for batch in batches:
        offsets, ids = _flat(batch.column(0))
        held.append((np.diff(offsets), ids, _flat(batch.column(1))[1]))
        if sum(len(x) for x, _, _ in held) >= _POOL_REPORTS or sum(len(x) for _, x, _ in held) >= _POOL_CELLS:
            yield together()
    if held:
        yield together()


def _by_length(lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows, longest first."""
    return rows[np.argsort(-lengths[rows], kind="stable")]


def _padded(rows: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts of some rows, the longest first, side by side; padded cells count zero."""
    lengths = offsets[rows + 1] - offsets[rows]
    at = np.arange(lengths[0])
    real = at < lengths[:, None]
    at = np.where(real, offsets[rows][:, None] + at, 0)
    return ids[at], np.where(real, counts[at], 0.0)


def _known(terms: pa.Array, counts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """Offsets, term numbers and counts of the terms that are in the vocabulary."""
    offsets, _ = _flat(terms)
    found = pc.index_in(terms.flatten(), vocabulary)
    keep = found.is_valid().to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(keep)])
    _, cnt = _flat(counts)
    ids = found.drop_null().to_numpy(zero_copy_only=False)
    return kept[offsets], ids, np.asarray(cnt[keep], dtype=np.float64)


def _counted(tokens: pa.ListArray, left_out: pa.Array) -> pa.StructArray:
    """Terms and counts of every row's tokens, in order of the terms, without those that are left out."""
    found = tokens.flatten().dictionary_encode()
    codes, order = found.indices.to_numpy(zero_copy_only=False), pc.array_sort_indices(found.dictionary)
    words = found.dictionary.take(order)
    rank = np.argsort(order.to_numpy(zero_copy_only=False)).astype(np.int64)[codes]
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    keep = ~pc.is_in(words, value_set=left_out).to_numpy(zero_copy_only=False)[rank]
    cells, counts = np.unique((np.repeat(np.arange(len(tokens)), lengths) * len(words) + rank)[keep], return_counts=True)
    rows, terms = np.divmod(cells, max(1, len(words)))
    ends = np.cumsum(np.bincount(rows, minlength=len(tokens)))
    at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    lists = pa.ListArray.from_arrays(at, words.take(pa.array(terms))), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))
    return pa.StructArray.from_arrays(lists, ["term", "cnt"])


def with_bags(
    reports: DataFrame, text_col: str, mode: str = "alpha3", stop_words: Sequence[str] | None = None, bag_col: str = "bag"
) -> DataFrame:
    """All columns of the reports with text, and the terms of each with their counts; no shuffle.

    Written once, without the text, the table serves the fit and the assignment, and the texts are read once.
    """
    short_batches(reports.sparkSession)
    stop = list(topics.default_stop_words() if stop_words is None else stop_words)

    @F.arrow_udf("struct<term:array<string>,cnt:array<int>>")
    def bag(tokens: pa.Array) -> pa.Array:
        return _counted(tokens, pa.array(stop, pa.string()))

    return drop_null_text(reports, text_col).withColumn(bag_col, bag.asNondeterministic()(tx.tokens(text_col, mode)))


def count_features(
    reports: DataFrame, text_col: str, terms: Sequence[str], mode: str = "alpha3", stop_words: Sequence[str] = ()
) -> DataFrame:
    """(ids, counts) per report with text: the positions of its terms in `terms` and how often they occur."""
    return _features(with_bags(reports, text_col, mode, stop_words, "_b"), "_b", terms)


def _features(bags: DataFrame, bag_col: str, terms: Sequence[str]) -> DataFrame:
    """(ids, counts) per bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms, pa.string())
        for batch in batches:
            offsets, ids, counts = _known(batch.column(0), batch.column(1), vocabulary)
            at = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                    "counts": pa.ListArray.from_arrays(at, pa.array(counts, pa.float64())),
                }
            )

    return bags.select(f"{bag_col}.term", f"{bag_col}.cnt").mapInArrow(run, _FEATURES)


def topics_step(
    features: DataFrame, weights: np.ndarray, prior: float, topic_prior: float, steps: int = 100, tolerance: float = 1e-3
) -> tuple[np.ndarray, float]:
    """One pass over all reports from a (topic, term) matrix: the next matrix, and the bound of the given one."""
    expected = expected_log(weights)
    job = _Inference(np.ascontiguousarray(np.exp(expected).T), prior, steps, tolerance)
    partial = features.mapInArrow(job.sums, "salt int, stats array<double>")
    total = Summarizer.sum(F.col("stats")).alias("stats")
    merged = partial.withColumn("stats", array_to_vector("stats")).groupBy("salt").agg(total).groupBy((F.col("salt") < 0).alias("all")).agg(total)
    row = merged.select(vector_to_array("stats").alias("stats")).first()
    stats = np.zeros(job.beta.size + 1) if row is None else np.asarray(row["stats"])
    bound = float(stats[-1]) + _dirichlet_gap(topic_prior, weights, expected)
    return topic_prior + stats[:-1].reshape(job.beta.shape).T, bound


@dataclass(frozen=True)
class BatchTopicModel:
    """Fitted topics: `weights` is (topic, term); `bounds` holds the bound before every pass."""

    session: SparkSession
    terms: tuple[str, ...]
    weights: np.ndarray
    bounds: tuple[float, ...]
    prior: float
    mode: str
    stop_words: tuple[str, ...]
    steps: int
    tolerance: float

    def term_weights(self) -> DataFrame:
        """(topic_id, term, weight) with weights that sum to one in a topic."""
        shares = self.weights / self.weights.sum(axis=1, keepdims=True)
        rows = [(i + 1, t, float(w)) for i, row in enumerate(shares) for t, w in zip(self.terms, row)]
        return small_table(self.session, rows, "topic_id int, term string, weight double")

    def top_words(self, n: int = topics.TOP_WORDS) -> DataFrame:
        return topics.topic_top_words(self.term_weights(), n=n)

    def keywords(self) -> DataFrame:
        return topics.topic_keywords(self.top_words())

    def assign(self, reports: DataFrame, text_col: str | None, bag_col: str | None = None) -> DataFrame:
        """All columns of `reports` with `word_count`, `topic_weights` and `topic_id`; no shuffle.

        Only the tokens and counts go to the Python workers, and all known terms of a report count. With `bag_col`,
        a column of `with_bags`, texts are not needed, and `word_count` is not added.
        """
        short_batches(reports.sparkSession)
        job = _Inference(np.ascontiguousarray(np.exp(expected_log(self.weights)).T), self.prior, self.steps, self.tolerance)
        known, k = list(self.terms), len(self.weights)

        @F.arrow_udf("array<double>")
        def infer(terms: pa.Array, counts: pa.Array) -> pa.Array:
            shares = job.weights(*_known(terms, counts, pa.array(known, pa.string())))
            ends = pa.array(np.arange(len(terms) + 1, dtype=np.int32) * k)
            return pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))

        rows = reports if bag_col else with_bags(reports, text_col, self.mode, self.stop_words, "_b")
        bag = bag_col or "_b"
        scored = rows.withColumn("topic_weights", infer.asNondeterministic()(F.col(f"{bag}.term"), F.col(f"{bag}.cnt")))
        if not bag_col:
            scored = scored.drop("_b").withColumn("word_count", tx.word_count(text_col))
        return scored.withColumn("topic_id", topics.dominant_topic("topic_weights"))


def topics_fit_batch(
    reports: DataFrame,
    text_col: str | None,
    k: int = 100,
    seed: int = 42,
    max_iter: int = 10,
    mode: str = "alpha3",
    stop_words: Sequence[str] | None = None,
    min_df: int = topics.MIN_DF,
    max_df: float = topics.MAX_DF,
    max_terms: int = topics.MAX_TERMS,
    steps: int = 100,
    tolerance: float = 1e-3,
    min_gain: float = 1e-5,
    bag_col: str | None = None,
) -> BatchTopicModel:
    """Learn the vocabulary, then pass all reports at most `max_iter` times.

    Both priors are 1/k. The fit ends early when a pass raises the bound of the likelihood by less than
    `min_gain` of its size. Terms and counts of the texts are written once, if they are not given as `bag_col`, a
    stored column of `with_bags` with the same mode and stop words; so are the counts of the vocabulary. A pass
    reads them and shuffles one matrix per task.
    """
    stop = tuple(topics.default_stop_words() if stop_words is None else stop_words)
    bags = reports
    if not bag_col:
        bag_col = "bag"
        bags = materialize(with_bags(reports.select(text_col), text_col, mode, stop).select(bag_col), "topic-bags")
    counted = topics.summed_terms(bags.select(F.inline(F.arrays_zip(f"{bag_col}.term", f"{bag_col}.cnt"))))
    vocab = topics.frequent_terms(counted, F.lit(bags.count()), min_df, max_df, max_terms)
    terms = tuple(sorted(r["term"] for r in vocab.select("term").collect()))
    if not terms:
        raise ValueError("no term passes the frequency bounds")
    features = materialize(_features(bags, bag_col, terms), "topic-counts")
    features = dealt_out(features).persist()
    prior = 1.0 / k
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (k, len(terms)))
    bounds: list[float] = []
    for _ in range(max_iter):
        weights, bound = topics_step(features, weights, prior, prior, steps, tolerance)
        bounds.append(bound)
        if len(bounds) > 1 and bounds[-1] - bounds[-2] < min_gain * abs(bounds[-2]):
            break
    features.unpersist()
    return BatchTopicModel(bags.sparkSession, terms, weights, tuple(bounds), prior, mode, stop, steps, tolerance)
