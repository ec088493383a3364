import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from narrascope.llm import align, bpe, piece_counts
from narrascope.llm.common import _caches

TEXTS = [
    "The quick brown fox, isn't it?", "naïve café – “quoted”", " two  blanks   here ", "\nstarts with a line\nand another\n", "tab\there\r\nwindows",
    "漢字かな交じり文 and emoji 😀👍🏽", "<|endoftext|> and <s> [x] </s> <0x0A> <unk>", "lower▁one eighth", "x\x00y\x1f", "é combining", "1234567890 3.14159", "a" * 500,
    "DON'T we'll I'm", "foo\n\nbar", "foo \nbar", "ends in blank ", " nbsp　wide", "ﬁ ligature ½", "...!!! ---", "a", " ", "\n",
]


@pytest.fixture(scope="module")
def own():
    return align.Aligner(bpe.default_path(), piece_counts.default_path())


def brute(own, text):
    """Groups of (A ids, B ids) by the common ends of two lists, from the two libraries on the whole text."""
    if not text:
        return []
    a = own.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    raw = b" " + text.encode()
    if b"".join(own.bytes_a[i] for i in a) != raw or b"".join(own.bytes_b[i] for i in b) != raw:
        return []
    ends_a = np.cumsum([len(own.bytes_a[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(own.bytes_b[i]) for i in b]).tolist()
    both, out, rest = set(ends_a) & set(ends_b), [], iter(zip(b, ends_b, strict=True))
    group = ([], [])
    for x, end in zip(a, ends_a, strict=True):
        group[0].append(x)
        if end in both:
            for y, end_y in rest:
                group[1].append(y)
                if end_y == end:
                    break
            out.append(group)
            group = ([], [])
    return out


def results(own, rows):
    groups = [(i, brute(own, t)) for i, t in rows]
    count = Counter((g[0][-1], g[1][-1]) for _, found in groups for g in found)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, found in groups:
        pairs = [(a[-1], b[-1]) for a, b in found]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out.append((
            i, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(pairs),
            sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest() if found else "",
        ))
    return sorted(out, key=str)


def corpus(n=300):
    rng = random.Random(8)
    words = ["the", "of", "naïve", "Straße", "tokenization", "isn't", "x_1", "2024", "(well)", "don't", "überraschend", "qzx", "été", "–", "C++"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) + rng.choice(["", ".", "\nNew line", "  two"])) for i in range(n)]


def test_words_and_whole_texts_agree(own):
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "ß", "'s", "1", "23", "–", ".", "▁", "漢", "\t", "<s>", "Zq", "ing", " "]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(5_000)]
    for text in texts:
        same, links, shown, many = own.text(text)
        want = brute(own, text)
        assert shown == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want), text
        assert (many & 0xFFFFFFFF, many >> 32) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want))
        assert len(same) // 4 + len(links) // 8 == len(want)


def test_identity_map(own):
    for a, b in enumerate(own.same_list):
        assert b == -1 or own.bytes_a[a] == own.bytes_b[b]
    assert sum(b >= 0 for b in own.same_list) > 10_000


@pytest.mark.parametrize("often", [align.OFTEN, 4, 1])
def test_documents_against_brute_force(make, own, monkeypatch, often):
    monkeypatch.setattr(align, "OFTEN", often)
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    got = sorted((tuple(r) for r in align.align(make(rows, 4)).collect()), key=str)
    assert got == results(own, rows)


def test_edges(make, edge_rows, own):
    rows = [r for r in edge_rows if r[0] not in (9, 10)] + [(20, " ".join(f"long{i % 401}" for i in range(20_000)))]
    got = align.align(make(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == results(own, rows)
    assert align.align(make([])).count() == 0 and align.align(make([(1, None)])).count() == 1


def test_caches_do_not_grow_with_long_words(own):
    import tracemalloc

    encoder, counter = bpe.Encoder(bpe.default_path()), piece_counts.counter(piece_counts.default_path())
    tracemalloc.start()
    for i in range(300):
        word = f"{i}" + "q" * 500
        own.text(word), encoder.encode(word), counter[word]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 300_000 and all(c.used <= max(c.limit, 0) for c in _caches)
    small = bpe.Encoder(bpe.default_path(), limit=1_000)
    for i in range(100):
        small.encode(f"word{i} word{i + 1}")
    assert small.known.used <= 1_000
