"""Quality rules whose cutoffs are certified on labelled documents by exact binomial tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import hashed, ship, steps, stored, utf8, windows

_SPACE = " \t\n\r\x0b\x0c"
#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of good documents of a stratum that all rules together may reject, and the chance that any stratum breaks it.
ALPHA, DELTA = 0.01, 0.05
#: One of so many good documents proposes cutoffs, the others certify them; steps from mild to the proposal.
PROPOSE, STEPS = 4, 48
#: Statistics on which a larger value is worse, with the cutoffs that are tried, from mild to strict.
RATIOS = {
    "symbol_ratio": np.geomspace(8.0, 0.01, 48),
    "dup_line_ratio": np.linspace(0.98, 0.02, 48),
    "repeat_ratio": np.linspace(0.98, 0.02, 48),
    "upper_ratio": np.linspace(0.98, 0.02, 48),
    "mark_ratio": np.geomspace(8.0, 0.01, 48),
    "long_word": np.geomspace(60.0, 6.0, 48),
    "short_word": np.geomspace(1.0, 0.16, 48),
    "one_word_ratio": np.linspace(0.98, 0.05, 48),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def n_repeat_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    _, where, times = np.unique(windows(words, 3), return_inverse=True, return_counts=True)
    often = times[where] > 1
    cover = np.zeros(len(words), bool)
    for i in range(3):
        cover[i : len(words) - 2 + i] |= often
    return int(cover.sum())


def measure(text: str | None) -> tuple:
    """The counts of `COUNTS`, then the ratios of `RATIOS`, of one whole text."""
    raw = utf8(text)
    split = raw.split()
    n = len(split)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    words = hashed(split)
    chars = len(raw.translate(None, _SPACE.encode()).decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = n_repeat_words(words)
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marks = raw.count(b"!") + raw.count(b"?")
    top = int(np.unique(words, return_counts=True)[1].max())
    ratios = (
        symbols / n, dup / len(lines), repeat / n, upper / max(1, letters), marks / n,
        chars / n, n / chars, top / n,
    )
    return (n, chars, symbols, dup, repeat, *ratios)


def base_failed(n_words: int, repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words


def binomial_tail(x: np.ndarray, n: int, p: float) -> np.ndarray:
    """P(X <= x) of a binomial X of n draws with chance p, for each x, exact up to rounding."""
    i = np.arange(int(x.max()) + 1 if len(x) else 0)
    log_n = math.lgamma(n + 1)
    log = np.array(
        [log_n - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in i]
    )
    return np.minimum(1.0, np.exp(np.logaddexp.accumulate(log)))[x]


@dataclass(frozen=True)
class Rules:
    """Certified cutoffs: (stratum, ratio) -> cutoff; a document is rejected above it."""

    cutoffs: dict[tuple[str | None, str], float]

    def rejects(self, stratum: str | None, ratios: Sequence[float]) -> bool:
        return any(r > self.cutoffs.get((stratum, k), math.inf) for k, r in zip(RATIOS, ratios, strict=True))


def features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """doc_id, stratum, counts and ratios of every document, in one pass over the texts."""
    ship(docs.sparkSession)
    names = [*COUNTS, *RATIOS]
    kinds = ["long"] * len(COUNTS) + ["double"] * len(RATIOS)
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("stratum", pa.string())]
        + [(n, pa.int64() if k == "long" else pa.float64()) for n, k in zip(names, kinds, strict=True)]
    )

    def run(batches):
        for batch in steps(batches):
            rows = list(map(measure, batch[2].to_pylist()))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            made = [pa.array(list(c), arrow.field(i + 2).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], *made], schema=arrow)

    wanted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(stratum_col).cast("string").alias("stratum"),
        F.col(text_col).cast("string").alias("text"),
    )
    return wanted.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def _above(ratio: str, cuts: np.ndarray) -> Column:
    """How many cutoffs a document is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts.tolist())), lambda c: c < F.col(ratio)))


def _by_stratum(spark, strata: list[str | None], values: list, kind: pa.DataType) -> DataFrame:
    """(_stratum, _value) as a table whose size the planner knows."""
    return spark.createDataFrame(pa.table({"_stratum": pa.array(strata, pa.string()), "_value": pa.array(values, kind)}))


def certify(measured: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> Rules:
    """Cutoffs from all labelled documents that pass the base rule.

    Every stratum (a null one too) stands for itself. A quarter of its good documents, chosen by a hash,
    and its bad ones propose a cutoff per ratio. The other good documents test the rules together, in
    `STEPS` steps from mild to the proposal: "more than `alpha` of the good documents are rejected by any
    rule" must fall at level `delta` / strata by the exact binomial test, and the first step that does not
    pass ends the sequence. As the steps do not depend on the documents that test them, the chance that
    any stratum breaks its bound is at most `delta`. Strata are those with any good label; where these are
    too few to certify anything the test itself fails, whatever the size of the table.
    The driver only sees counts per stratum, ratio and cutoff, and per stratum and step.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    above = [F.struct(F.lit(k).alias("ratio"), _above(k, cuts).alias("above")) for k, cuts in RATIOS.items()]
    proposes = (F.col("quality") == 0) | (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PROPOSE)) == 0)
    rows = measured.where(~base).join(marks, "doc_id")
    marked = stored(rows.select("stratum", "quality", proposes.alias("proposes"), F.array(*above).alias("above")), "quality-labelled")
    good = [r["stratum"] for r in marked.where("quality != 0").groupBy("stratum").count().collect()]
    known = set(good)
    counts = marked.where("proposes").select("stratum", "quality", F.explode("above").alias("s"))
    tables: dict[tuple[str | None, str], np.ndarray] = {}
    for r in counts.groupBy("stratum", "quality", "s.ratio", "s.above").count().collect():
        if r["stratum"] in known:
            table = tables.setdefault((r["stratum"], r["ratio"]), np.zeros((2, 49), np.int64))
            table[1 if r["quality"] else 0, r["above"]] += r["count"]
    proposed: dict[tuple[str | None, str], int] = {}
    for (own, ratio), (bad, fine) in tables.items():
        n = len(RATIOS[ratio])
        # A document above the strictest `k` cutoffs (the list falls) is rejected by the last k of them.
        fine_out, bad_out = (np.cumsum(t[::-1])[::-1][n - np.arange(n)] for t in (fine, bad))
        gain = np.where(fine_out <= alpha / len(RATIOS) * fine.sum(), bad_out - fine_out, -1)
        if gain.max() > 0:
            proposed[own, ratio] = int(np.argmax(gain))
    # Step k has each ratio at k / STEPS of its way to the proposal; a document notes the first that rejects it.
    levels = {key: np.ceil(np.arange(1, STEPS + 1) * (best + 1) / STEPS).astype(int) - 1 for key, best in proposed.items()}
    if not levels:
        return Rules({})
    # Per stratum and ratio, the first step that rejects a document above x of the n cutoffs: at level n - x or later.
    owners = sorted({own for own, _ in levels}, key=str)
    never = [STEPS] * (max(map(len, RATIOS.values())) + 1)
    first = [
        [np.searchsorted(levels[own, k], len(cuts) - np.arange(len(cuts) + 1)).tolist() if (own, k) in levels else never for k, cuts in RATIOS.items()]
        for own in owners
    ]
    steps_of = _by_stratum(measured.sparkSession, owners, first, pa.list_(pa.list_(pa.int64())))
    fine = marked.where("quality != 0 and not proposes").join(steps_of, F.col("stratum").eqNullSafe(F.col("_stratum")))
    step = F.array_min(F.zip_with("above", "_value", lambda x, at: F.element_at(at, x["above"] + 1)))
    rejected = {own: np.zeros(STEPS + 1, np.int64) for own in owners}
    for r in fine.groupBy("stratum", step.alias("step")).count().collect():
        rejected[r["stratum"]][r["step"]] += r["count"]
    cutoffs = {}
    for own, out in rejected.items():
        certified = binomial_tail(np.cumsum(out)[:STEPS], int(out.sum()), alpha) <= delta / len(good)
        length = STEPS if certified.all() else int(np.argmin(certified))
        for ratio in RATIOS:
            if length and (own, ratio) in levels:
                cutoffs[own, ratio] = float(RATIOS[ratio][levels[own, ratio][length - 1]])
    return Rules(cutoffs)


def verdicts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    **limits,
) -> DataFrame:
    """Counts, ratios, base verdict and verdict of every document.

    Texts are read once; the narrow table of counts is stored, joined to the labels for the cutoffs,
    and judged. A null or empty text has no words and fails the base rule. Labels without id or quality
    are ignored, of several labels of a document the lowest counts, and a null stratum is one of its own.
    In a stratum without certified cutoffs, unseen ones included, the base rule decides alone. Repeated rows give one row each.
    """
    measured = stored(features(docs, id_col, text_col, stratum_col), "quality-features")
    rules = certify(measured, labels, **limits)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    strata = sorted({own for own, _ in rules.cutoffs}, key=str)
    cuts = [[rules.cutoffs.get((own, k), math.inf) for k in RATIOS] for own in strata]
    cutoffs = _by_stratum(docs.sparkSession, strata, cuts, pa.list_(pa.float64()))
    over = F.exists(F.zip_with(F.array(*RATIOS), "_value", lambda x, cut: x > cut), lambda x: x)
    return (
        measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~(F.col("base_failed") | F.coalesce(over, F.lit(False))))
        .drop("stratum", "_stratum", "_value")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **limits
) -> DataFrame:
    """The rows of `docs`, all columns, that pass the base rule and the certified cutoffs.

    Two passes over the texts instead of a join, so that text is never shuffled.
    """
    rules = certify(stored(features(docs, id_col, text_col, stratum_col), "quality-features"), labels, **limits)
    text_at, stratum_at = docs.columns.index(text_col), docs.columns.index(stratum_col)
    first = len(COUNTS)

    def run(batches):
        for batch in batches:
            keep = []
            for text, stratum in zip(batch.column(text_at).to_pylist(), batch.column(stratum_at).to_pylist(), strict=True):
                row = measure(text)
                keep.append(not base_failed(row[0], row[4]) and not rules.rejects(stratum, row[first:]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
