import random
import zlib

import numpy as np
import pytest

from narrascope.llm import bpe, packing, piece_counts, token_files

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_path())


@pytest.fixture(scope="module")
def want(encoder):
    return lambda text: np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_words_give_the_ids_of_the_whole(encoder):
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", ".", ",", "'s", "'", "é", "\t", " ", "12", "²", "_", "<|endoftext|>", "…", "漢", " \n", "×"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    assert encoder.cuts and 1000 < sum(map(encoder.can_cut, texts)) < 19_000
    assert all(encoder.encode(t) == encoder.library(t) for t in texts)


def test_forgetting_words_changes_nothing():
    small, large = bpe.Encoder(bpe.default_path(), limit=3), bpe.Encoder(bpe.default_path())
    text = "the cat and the dog and the cat, and so on."
    assert small.encode(text) == large.encode(text) == large.library(text)


def test_known_words_are_not_encoded_again_before_marks():
    encoder = bpe.Encoder(bpe.default_path())
    encoder.encode("a thananha b, c")
    seen, encoded = [], encoder.known.inner.encoded
    encoder.known.inner.encoded = lambda piece: seen.append(piece) or encoded(piece)
    text = "a thananha, thananha.*** thananha"
    assert encoder.encode(text) == encoder.library(text)
    assert seen == ["a", ".***"]


def test_files_round_trip(spark, make, edge_rows, want, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write(make(edge_rows), path, bucket_keys=4)
    got = token_files.read(spark, path).collect()
    assert len(got) == len(edge_rows)
    start = 0
    for row in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["occurrence"])):
        texts = [t for d, t in edge_rows if d == row["doc_id"]]
        assert row["start"] == start and row["n_tokens"] * 4 == len(row["ids"])
        assert row["ids"] in [want(t).tobytes() for t in texts]
        start += row["n_tokens"]
    asked = spark.createDataFrame([(9, 0), (777, 0), (2, 1), (2, 2)], "doc_id long, occurrence long")
    assert sorted((r["doc_id"], r["occurrence"]) for r in token_files.read(spark, path, asked).collect()) == [(2, 1), (9, 0)]


def test_no_documents(spark, make, tmp_path):
    token_files.write(make([]), f"{tmp_path}/ids")
    assert token_files.read(spark, f"{tmp_path}/ids").count() == 0
    assert packing.pack(make([])).count() == 0
    assert piece_counts.token_counts(make([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**63, 2 * n).astype(np.uint64)
    built = token_files.Bucket.build(keys[:n], np.arange(n), np.arange(n), np.arange(n))
    again = token_files.Bucket.from_bytes(built.to_bytes())
    slot = again.find(keys[:n])
    assert sorted(slot) == list(range(n)) and (again.first[slot] == np.arange(n)).all()
    assert (again.find(keys[n:]) < 0).mean() > 0.999 if n else True
    if n > 1:
        with pytest.raises(ValueError, match="distinct"):
            token_files.PerfectHash.build(np.array([5, 5], np.uint64))


def check_pieces(got, rows, want, window):
    pieces, used = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(used) == set(range(len(used)))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for key in {d for d, _ in rows}:
        texts = sorted(want(t).tobytes() for d, t in rows if d == key)
        own = sorted(pieces[key], key=lambda r: r["start"])
        if len(texts) == 1:
            assert b"".join(r["ids"] for r in own) == texts[0]
            assert [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert sum(r["length"] for r in own) * 4 == sum(map(len, texts))
    total = sum(len(want(t)) for _, t in rows)
    assert len(used) == -(-total // window)


@pytest.mark.parametrize("window", [8, 64, 1024])
def test_packing(make, edge_rows, want, window):
    rng = random.Random(window)
    rows = edge_rows + [(100 + i, " ".join(rng.choice(["a", "the", "of"]) for _ in range(rng.choice([3, 17, 40, 40])))) for i in range(300)]
    check_pieces(packing.pack(make(rows), window=window).collect(), rows, want, window)


def test_fit_reproduces_a_histogram_of_combinations():
    histogram = np.zeros(101, np.int64)
    for piece, times in [(60, 500), (40, 500), (25, 800), (50, 400)]:
        histogram[piece] += times
    plan = packing.Plan(histogram, 100)
    assert plan.stream == 0 and plan.sequences == 500 + 400
    x = packing.fit(packing.combinations(np.flatnonzero(histogram), 100), histogram)
    assert (x >= 0).all()


def test_one_length_only():
    histogram = np.zeros(1025, np.int64)
    histogram[600] = 1000
    plan = packing.Plan(histogram, 1024)
    ends = sum((plan.place(600, i) for i in range(1000)), [])
    assert plan.sequences == 0 and sum(x[2] for x in ends) == 600_000 and max(x[0] for x in ends) == 600_000 // 1024


def test_greedy_longest_match(make, edge_rows):
    pieces = set(piece_counts.vocabulary(piece_counts.default_path()))
    counter = piece_counts.PieceCounter(pieces)
    longest = max(map(len, pieces))

    def naive(word):
        at = n = 0
        while at < len(word):
            if word[at] not in counter.single:
                n, at = n + len(word[at].encode()), at + 1
                continue
            at += next(k for k in range(longest, 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    rng = random.Random(0)
    words = ["".join(rng.choice("abtheinor▁漢éxyz0") for _ in range(rng.randint(1, 20))) for _ in range(5000)]
    assert [counter.count(w) for w in words] == [naive(w) for w in words]
    got = {(r["doc_id"], r["n_words"], r["n_tokens"]) for r in piece_counts.token_counts(make(edge_rows)).collect()}
    ascii_words = lambda t: (t or "").encode().decode("latin-1").split()
    assert (3, 0, 0) in got and (6, 2, naive("▁one") + naive("▁two")) in got
    assert {(d, n) for d, n, _ in got if d != 11} == {(d, len(ascii_words(t))) for d, t in edge_rows if d != 11}


def test_crc_of_pieces(make, want):
    row = packing.pack(make([(1, "hello world")])).first()
    assert zlib.crc32(row["ids"]) == zlib.crc32(want("hello world").tobytes())
