import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from narrascope.llm import class_lm as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(held out, tokens, known tokens, training tokens, base score) of every row."""
    split = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter(w for words, h in zip(split, held, strict=True) if not h for w in words)
    n, v = sum(counts.values()), len(counts)
    return [
        (d, h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for (d, _), ws, h in zip(rows, split, held, strict=True)
    ]


def same(got, want):
    key = lambda r: repr((r[0], r[2], r[3]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def sentences(n):
    """Two kinds of words that take turns, each drawn from a long list: only classes can see the order."""
    rng = random.Random(4)
    names, deeds = [f"name{i}" for i in range(60)], [f"deed{i}" for i in range(60)]
    return [(i, " ".join(rng.choice(names if k % 2 else deeds) for k in range(40))) for i in range(n)]


def test_edges_and_base(make, edge_rows):
    for limits in ({}, {"head": 5, "assigned": 3, "swapped": 2, "classes": 2}):
        same(lm.score(make(edge_rows), **limits).drop("score", "perplexity").collect(), brute(edge_rows))


def test_no_training_documents(make):
    rows = [(d, "a b") for d in range(60) if lm.is_held_out(d)]
    same(lm.score(make(rows)).drop("score", "perplexity").collect(), brute(rows))
    assert lm.score(make([])).count() == 0


def test_classes_beat_single_words_on_held_out_text(make):
    rows = sentences(700)
    for limits in ({}, {"swapped": 60}):
        got = [r for r in lm.score(make(rows), classes=4, **limits).collect() if r["held_out"]]
        gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
        assert len(got) > 50 and gain > 0.25  # log10 of two is 0.30


def test_exchange_separates_words_by_their_neighbours():
    bigrams = np.zeros((21, 21), np.int64)
    rng = np.random.default_rng(1)
    for i in range(20):
        for j in range(20):
            if i % 2 != j % 2:
                bigrams[i, j] = rng.integers(5, 20)
    fixed = np.full(21, -1)
    fixed[20] = 2
    start = np.random.default_rng(2).permutation(20)
    own = lm.exchange(bigrams[np.ix_([*start, 20], [*start, 20])], fixed, 2)
    assert len({(int(own[k]), int(start[k]) % 2) for k in range(20)}) == 2


def test_gains_are_changes_of_the_likelihood():
    rng = np.random.default_rng(3)
    bigrams = rng.integers(0, 30, (12, 12))
    own = np.arange(12) % 3

    def likelihood(classes):
        hot = np.eye(3)[classes]
        joint = hot.T @ bigrams @ hot
        count = (bigrams.sum(0) + bigrams.sum(1)) / 2
        total = np.bincount(classes, weights=count, minlength=3)
        return lm.xlogx(joint).sum() - 2 * lm.xlogx(total).sum()

    w = 5
    rest = np.delete(np.arange(12), w)
    hot = np.eye(3)[own[rest]]
    joint = hot.T @ bigrams[np.ix_(rest, rest)] @ hot
    count = (bigrams.sum(0) + bigrams.sum(1)) / 2
    total = np.bincount(own[rest], weights=count[rest], minlength=3)
    out = np.bincount(own[rest], weights=bigrams[w, rest], minlength=3)
    into = np.bincount(own[rest], weights=bigrams[rest, w], minlength=3)
    gain = lm.gains(joint, total, out, into, float(bigrams[w, w]), count[w])
    want = [likelihood(np.where(np.arange(12) == w, c, own)) for c in range(3)]
    assert np.allclose(gain - gain[0], np.array(want) - want[0])


def test_transitions_and_emissions_sum_to_one(spark, make):
    docs = make(sentences(200)).select("doc_id", "text")
    counts = lm.word_counts(docs)
    model = lm.train(docs, counts, head=50, assigned=40, swapped=30, classes=4, sweeps=2)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    sums = np.bincount(model.head.classes, weights=10**model.emission)
    assert np.allclose(sums[sums > 0], 1)


def test_moves_are_exchange_moves_out_of_the_last_class():
    rng = np.random.default_rng(5)
    bigrams = rng.integers(0, 6, (12, 12)) * rng.integers(0, 2, (12, 12))
    own = np.array([0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 3, 3])
    joint = np.eye(4)[own].T @ bigrams @ np.eye(4)[own]
    for w in (8, 9, 10, 11):
        others = np.arange(12) != w
        out = np.bincount(own[others], weights=bigrams[w, others], minlength=4)
        into = np.bincount(own[others], weights=bigrams[others, w], minlength=4)

        def likelihood(c, w=w):
            hot = np.eye(4)[np.where(np.arange(12) == w, c, own)]
            count = hot.T @ (bigrams.sum(0) + bigrams.sum(1)) / 2
            return lm.xlogx(hot.T @ bigrams @ hot).sum() - 2 * lm.xlogx(count).sum()

        best = lm.moves(joint, np.concatenate([out, into, [bigrams[w, w]]])[None], 3)[0]
        assert best == np.argmax([likelihood(c) for c in range(3)])


def test_every_word_seen_twice_gets_the_class_of_its_contexts(spark, make):
    """Most words are beyond the clusters and half of them beyond the head, and the order is still seen."""
    rows = sentences(700)
    got = [r for r in lm.score(make(rows), classes=4, head=60, swapped=20).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.2
    same(lm.score(make(rows), classes=4, head=60, swapped=20).drop("score", "perplexity").collect(), brute(rows))
