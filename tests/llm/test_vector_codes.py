import random

import numpy as np
import pytest

from narrascope.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, ids long"


@pytest.fixture(scope="module")
def table(spark):
    def run(rows, parts=3):
        return spark.createDataFrame([(i, v, x, "c", "e", 1) for i, v, x in rows], SCHEMA).repartition(parts)

    return run


def brute(rows, parts, entries, rounds):
    """Codes, errors and codebooks by comparing every part with every entry in plain integers."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    ints = [[int(np.floor(np.float64(np.float32(c)) * 1024)) for c in v] for _, v, _ in kept]
    size = len(ints[0]) // parts
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    seeds = [min(v for (i, _, _), v in zip(kept, ints, strict=True) if i == want) for want in ids]
    books = [[list(s[p * size : (p + 1) * size]) for s in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in ints:
                x = v[p * size : (p + 1) * size]
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for (i, _, label), v in zip(kept, ints, strict=True):
        found = [nearest(v[p * size : (p + 1) * size], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def check(table, rows, parts=2, entries=8, rounds=4, block=16):
    codes, books = vc.compress(table(rows), parts=parts, entries=entries, rounds=rounds, block=block)
    got = vc.with_label_errors(codes).collect()
    want, want_books = brute(rows, parts, entries, rounds)
    assert [b.tolist() for b in books] == want_books
    labels = {}
    for _, label, _, error in want:
        labels[label] = labels.get(label, 0) + error
    ints = [(r["vec_id"], None if r["label"] is None else int(r["label"]), r["code"], r["error"], r["label_error"]) for r in got]
    assert sorted(ints, key=key) == sorted([(*w, labels[w[1]]) for w in want], key=key)


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors(table, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, (0.02, 0.5)[i % 2]) for x in c]
        rows.append((i, [round(x, 2) for x in v] if seed else v, rng.choice([None, 1, 2])))
    check(table, rows)


def test_edges(table):
    rng = random.Random(9)
    same = [0.5, -0.25, 0.125, 1.0]
    rows = [(100 + i, same, 1) for i in range(60)]
    rows += [(i, [float(rng.randint(-2, 2)) for _ in range(4)], i % 3 or None) for i in range(80)]
    rows += [(3, [9.0, 9.0, 9.0, 9.0], 1), (3, [9.0, 9.0, 9.0, 9.0], 1), (None, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(500, None, 1), (501, [1.0, None, 1.0, 1.0], 1), (502, [1.0, float("nan"), 1.0, 1.0], 1), (503, [float("inf")] * 4, None), (504, [-1e-6, 0.0, 0.0, 2000.0], 2)]
    check(table, rows)
    check(table, rows[:5], entries=256)
    check(table, [(7, same, None)])


def test_empty_and_without_ids(table):
    for rows in ([], [(1, None, 1)]):
        codes, books = vc.compress(table(rows))
        assert vc.with_label_errors(codes).count() == 0 and books == []
    codes, books = vc.compress(table([(None, [1.0] * 4, 1)]))
    assert [tuple(r) for r in codes.collect()] == [(None, "1", None, None)] and books == []


def test_large_components_are_exact(table):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-60_000, 60_000) for _ in range(4)], 0) for i in range(150)]
    check(table, rows, entries=16)
    with pytest.raises(Exception, match="beyond"):
        vc.compress(table([(1, [1e9, 0.0], 0)]), parts=2)[0].collect()


def test_rows_dealt_otherwise_give_the_same(table):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 2) for i in range(300)]
    results = [vc.compress(table(rows, parts), entries=32, block=block) for parts, block in ((1, 300), (7, 16))]
    assert vc.digest(results[0][1]) == vc.digest(results[1][1])
    assert [sorted(map(tuple, r[0].collect())) for r in results][0] == sorted(map(tuple, results[1][0].collect()))


def test_tree_covers_and_settles_subtrees():
    rng = np.random.default_rng(0)
    points = (rng.normal(0, 1, (8, 4))[rng.integers(0, 8, 1000)] * 5000 + rng.normal(0, 40, (1000, 4))).astype(np.int64)
    tree = vc.CoverTree.of(points)
    assert (tree.points[tree.place] == points).all() and tree.weights.sum() == 1000
    for n in range(len(tree.centre)):
        below = tree.points[tree.low[n] : tree.high[n]]
        assert (np.sqrt(((below - tree.points[tree.centre[n]]) ** 2).sum(axis=1)) <= tree.radius[n] + 1e-6).all()
        if tree.radius[n] > 0:
            kids = range(tree.first[n], tree.last[n])
            assert [tree.low[k] for k in kids][0] == tree.low[n] and [tree.high[k] for k in kids][-1] == tree.high[n]
            assert all(tree.high[a] == tree.low[b] for a, b in zip(kids, kids[1:], strict=False))
    book = points[rng.integers(0, 1000, 12)]
    opened = sum(len(nodes) for nodes, _ in tree.settled(book))
    assert opened < 900  # whole subtrees are assigned
