import hashlib
import re

import pytest

from narrascope.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, width=10):
    wins = {}
    for i, text in items:
        w = words(text)
        k = min(width, len(w))
        if i is not None and k:
            for j in range(len(w) - k + 1):
                wins.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit.update(range(j, j + k))
                    names |= wins[tuple(w[j : j + k])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


ITEM = "Alpha beta, gamma; delta-epsilon zeta eta theta iota kappa lambda MU nu"
ITEMS = [(10, ITEM), (9, ITEM), (2, "SHORT één x"), (3, None), (None, "other words"), (4, ""), (5, "...")]
CASES = [
    (21, "x " + ITEM.upper().replace(",", " !") + " y"), (22, ITEM[6:]), (23, "pre short één X post short één x"),
    (24, "theta iota kappa"), (25, "shorter één x"), (26, "漢 " + ITEM + " " + ITEM),
]


@pytest.mark.parametrize("part_chars", [d.PART_CHARS, 120])
def test_matches_brute_force(spark, make, edge_rows, part_chars):
    rows = edge_rows + CASES
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.contamination(make(rows), bench, part_chars=part_chars).drop("items", "spans")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, ITEMS)


def test_spans_point_into_the_original(spark, make):
    text = "é — " + ITEM + "! tail"
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = d.contamination(make([(1, text)]), bench).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == [ITEM]
    assert row["items"] == ["10", "9"]


def test_empty_tables_and_dropping(spark, make, edge_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(make([]), none).count() == 0
    docs = make(edge_rows + CASES)
    assert d.drop_contaminated(docs, none).count() == docs.count()
    kept = d.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} & {c[0] for c in CASES} == {24, 25}
