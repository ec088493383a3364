"""Valence of a text by rules on the words around: boosters, negation, contrast, capitals, exclamation marks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions import text as tx
from narrascope.functions.sizing import MAX_BROADCAST_ROWS

BOOSTER, NEGATION, CONTRAST = "booster", "negation", "contrast"
# Fixed values of the published rules: damping by distance of a booster, which is also how far back boosters and
# negations reach; factor of a negated word; step of a capitalised word; weights before and after a contrast
# word; step of an exclamation mark and how many of them count.
DAMPING = (1.0, 0.95, 0.9)
NEGATED = -0.74
CAPITALS = 0.733
BEFORE, AFTER = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
# Punctuation around a word, and a word without small letters.
_AROUND = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
_SHOUTED = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"


def _rules_of(rules: DataFrame) -> dict[str, dict[str, float]]:
    """Steps by kind and lower-cased word; several entries of a word and kind count with their mean.

    Rules are a list that people have written, so every task holds them; their number is checked.
    """
    named = rules.where("word IS NOT NULL").groupBy("kind", F.lower("word").alias("w"))
    rows = named.agg(F.avg(F.col("step").cast("double")).alias("step")).limit(MAX_BROADCAST_ROWS + 1).collect()
    if len(rows) > MAX_BROADCAST_ROWS:
        raise ValueError(f"a rule table may have {MAX_BROADCAST_ROWS} words")
    found: dict[str, dict[str, float]] = {BOOSTER: {}, NEGATION: {}, CONTRAST: {}}
    for r in rows:
        if r["kind"] not in found:
            raise ValueError(f"unknown kind of rule {r['kind']!r}")
        found[r["kind"]][r["w"]] = r["step"] or 0.0
    return found


def ruled_sum(text: Column | str, words: Sequence[str], values: Sequence[float], rules: DataFrame) -> Column:
    """Valence sum of a text under a (word, kind, step) table; `words` and `values` are the lexicon.

    Words are split at white space and freed of punctuation around them. A word with a valence is raised where it
    is capitalised in a text that is not so throughout, moved in its own direction by the boosters shortly
    before it, and turned round by a negation there. Words before the first contrast word count less, words
    after it more. Exclamation marks strengthen what comes out. A text without words sums up to 0.
    """
    text = F.col(text) if isinstance(text, str) else text
    by_kind = _rules_of(rules)
    boosters = by_kind[BOOSTER]
    lists = {kind: pa.array(list(by_kind[kind]), pa.string()) for kind in by_kind}
    steps = pa.array(list(boosters.values()), pa.float64())
    lexicon, valences = pa.array(list(words), pa.string()), pa.array(list(values), pa.float64())

    @F.arrow_udf("double")
    def total(lowered: pa.Array, shouted: pa.Array) -> pa.Array:
        def looked_up(names: pa.Array, numbers: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.take(numbers, pc.index_in(flat, names)), 0.0).to_numpy(zero_copy_only=False)

        flat = lowered.flatten()
        lengths = pc.fill_null(pc.list_value_length(lowered), 0).to_numpy(zero_copy_only=False)
        row, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat))
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        value, step = looked_up(lexicon, valences), looked_up(lists[BOOSTER], steps)
        negation, contrast = (
            pc.is_in(flat, lists[kind]).to_numpy(zero_copy_only=False).astype(bool) for kind in (NEGATION, CONTRAST)
        )
        loud = shouted.flatten().to_numpy(zero_copy_only=False).astype(bool)

        sign = np.sign(value)
        n_loud = np.bincount(row, loud, len(lengths))
        value = value + sign * CAPITALS * (loud & (n_loud < lengths)[row])
        negated = np.zeros(len(flat), bool)
        for back, damping in enumerate(DAMPING, 1):
            seen, there = at - back >= begin, np.maximum(at - back, 0)
            value = value + sign * damping * np.where(seen, step[there], 0.0)
            negated |= seen & negation[there]
        value = np.where(negated, value * NEGATED, value)

        turn = np.full(len(lengths), len(flat))
        np.minimum.at(turn, row[contrast], at[contrast])
        turn = turn[row]
        there = turn < len(flat)
        weight = np.where(there & (at < turn), BEFORE, np.where(there & (at > turn), AFTER, 1.0))
        return pa.array(np.bincount(row, value * weight, len(lengths)), pa.float64())

    bare = F.transform(F.split(text, tx.WHITESPACE), lambda w: F.regexp_replace(w, _AROUND, ""))
    bare = F.array_remove(bare, "")
    loud = F.transform(bare, lambda w: w.rlike(_SHOUTED) & (F.length(w) > 1))
    summed = F.round(total(F.transform(bare, lambda w: F.lower(w)), loud), 6)
    marks = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(MAX_EXCLAMATIONS))
    return F.round(summed + F.signum(summed) * marks * EXCLAMATION, 6)
