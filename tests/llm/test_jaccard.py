import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from narrascope.llm import jaccard
from narrascope.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    """Set size and smallest id of the component of every row with an id, by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        sets.append(set(grams) if len(words) >= width else {tuple(words)} - {()})
    ids = [i for i, (d, _) in enumerate(rows) if d is not None]
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[b], group[a]
                group = {k: new if v == old else v for k, v in group.items()}
    least = defaultdict(list)
    for i, g in group.items():
        least[g].append(rows[i][0])
    return Counter(
        (d, len(sets[i]), min(least[group[i]]) if d is not None else None) for i, (d, _) in enumerate(rows)
    )


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def family(rng, size, copies, changes, first):
    """An original and copies of it with some words replaced: near the original, not near each other."""
    base = [f"b{first}x{i}" for i in range(size)]
    rows = [(first, " ".join(base))]
    for c in range(copies):
        words = list(base)
        for at in rng.sample(range(size), changes):
            words[at] = f"c{first}x{c}x{at}"
        rows.append((first + 1 + c, " ".join(words)))
    return rows


def test_edges(make, edge_rows):
    assert found(jaccard.near_duplicates(make(edge_rows), width=3, percent=90)) == brute(edge_rows, 3, 90)


@pytest.mark.parametrize(("width", "percent", "tile"), [(3, 90, 2048), (5, 80, 2048), (3, 90, 8)])
def test_all_links_are_kept(make, width, percent, tile):
    """Also when clusters span many tiles and when nothing links to an original."""
    rng = random.Random(width * tile)
    rows = []
    for k, (size, copies, changes) in enumerate([(200, 30, 3), (200, 30, 7), (25, 8, 1), (12, 6, 1), (60, 10, 2)]):
        rows += family(rng, size, copies, changes, 1000 * (k + 1))
    chain = [f"k{i}" for i in range(400)]
    rows += [(9000 + i, " ".join(chain[i * 4 : i * 4 + 150])) for i in range(20)]
    rng.shuffle(rows)
    got = jaccard.near_duplicates(make(rows), width=width, percent=percent, tile=tile)
    assert found(got) == brute(rows, width, percent)


def test_empty_table(make):
    assert jaccard.near_duplicates(make([])).count() == 0
    assert jaccard.keep_one(make([])).count() == 0


def test_keep_one(make, edge_rows):
    docs = make(edge_rows)
    kept = jaccard.keep_one(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, None, None, 6, 8, 9, 11])


def test_keep_one_judges_repeated_ids_by_their_own_text(make):
    text = [" ".join(f"t{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(1, text[0]), (5, text[0]), (5, text[1]), (6, text[2]), (6, text[3]), (6, text[3]), (7, text[3]), (8, None), (8, None), (8, text[2])]
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(make(rows)).collect())
    assert kept == Counter([(1, text[0]), (5, text[1]), (6, text[2]), (6, text[3]), (8, None)])


def test_candidates_connect_every_pair_that_links():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, int(rng.choice([30, 600, 5_000]))).astype(np.uint64))
        sets = [np.sort(base[rng.random(len(base)) < rng.uniform(0.7, 1)]) for _ in range(int(rng.integers(2, 9)))]
        sizes = np.array([len(s) for s in sets])
        edges = jaccard.candidate_forest([jaccard.fine_counts(s) for s in sets], sizes, 80)
        label = list(range(len(sets)))
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        for a in range(len(sets)):
            for b in range(a):
                if jaccard.overlap(sets[a], sets[b]) >= jaccard.needed(len(sets[a]), len(sets[b]), 80):
                    assert label[a] == label[b]
                assert jaccard.bounded_overlap(*(jaccard.fine_counts(sets[x]) for x in (a, b))) >= jaccard.overlap(sets[a], sets[b])


@pytest.mark.parametrize("percent", [80, 90])
def test_a_pair_that_links_shares_a_bucket(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        drop = int(rng.integers(0, n // 4 + 1))
        a = base[:n]
        b = np.unique(np.concatenate([base[drop:n], base[n : n + int(rng.integers(0, drop + 1))]]))
        if len(b) and len(set(a.tolist()) & set(b.tolist())) >= jaccard.needed(len(a), len(b), percent) and len(a) != len(b):
            assert set(jaccard.bucket_keys(a, percent).tolist()) & set(jaccard.bucket_keys(b, percent).tolist())


@pytest.mark.parametrize("percent", [80, 90])
def test_a_set_has_few_buckets_and_meets_its_farthest_links(percent):
    """No more buckets than differences in two levels, even for sizes at the borders of levels."""
    rng = np.random.default_rng(percent + 1)
    borders = [size for level in jaccard.levels(percent, 1500) for size in level[:2]]
    for n in [*borders, 50, 200, 500, 2500]:
        base = rng.choice(2**62, 2 * n + 10, replace=False).astype(np.uint64)
        a = np.sort(base[:n])
        keys = set(jaccard.bucket_keys(a, percent).tolist())
        assert len(keys) <= 2 * ((100 - percent) * (n + n * 100 // percent) // (100 + percent) + 1)
        for size in {n, n * 100 // percent, (n + n * 100 // percent) // 2, -(-n * percent // 100)}:
            shared = int(jaccard.needed(n, size, percent))
            for _ in range(20):
                b = np.sort(np.concatenate([rng.choice(a, shared, replace=False), base[n : n + size - shared]]))
                assert size == n == shared or keys & set(jaccard.bucket_keys(b, percent).tolist())


def test_tree_finds_every_pair_within_the_bound():
    rng = np.random.default_rng(5)
    base = rng.poisson(5, (40, jaccard.DIMENSIONS))
    points = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape)) for _ in range(6)])
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    for p, s in zip(points, sizes, strict=True):
        bound = np.minimum(points, p).sum(axis=1) >= jaccard.needed(s, sizes, 90)
        fits = (90 * s <= 100 * sizes) & (90 * sizes <= 100 * s)
        assert set(tree.near(p, s, 90)) == set(np.flatnonzero(bound & fits))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}
