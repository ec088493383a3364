import math
import random
import re
from collections import Counter

import numpy as np

from narrascope.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if wins[w] > 1 for k in range(3)}
    seen = [x for i, x in enumerate(lines) if x in lines[:i]]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(seen), len(hit)


TEXTS = ["a b c a b c", "a b c\na b c\n\n \nd", "x a b a b a b a", "# * $ %é&|<>", "l\r\nl\r\nm", "\x0b\x0c", "a b c d", "a a a a"]


def test_counts(make, edge_rows):
    for text in TEXTS + [t for _, t in edge_rows]:
        assert q.measure(text)[:5] == brute(text)


def labelled(spark, make, n=3000):
    """Good prose, and bad texts that shout or repeat lines."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        bad = i % 5 == 0
        if bad and i % 2:
            words = [w.upper() for w in words]
        elif bad:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    return make(rows), spark.createDataFrame([*labels, (None, 1), (1, 1), (5, None)], "doc_id long, quality int")


def test_bad_go_and_good_stay(spark, make):
    docs, labels = labelled(spark, make)
    got = q.verdicts(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 5 != 0) for r in got) and len(got) == 3000
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_without_labels_the_base_rule_decides(spark, make, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.verdicts(make(edge_rows), none).collect()
    assert len(got) == len(edge_rows)
    assert all(r["kept"] == (not r["base_failed"]) and r["base_failed"] == q.base_failed(r["n_words"], r["n_repeat_words"]) for r in got)
    assert q.verdicts(make([]), none).count() == 0


def test_binomial_tail():
    for n, p in [(1, 0.5), (30, 0.1), (900, 0.01)]:
        x = np.arange(min(n, 12) + 1)
        exact = np.cumsum([math.comb(n, int(k)) * p**k * (1 - p) ** (n - k) for k in x])
        assert np.allclose(q.binomial_tail(x, n, p), exact)


def test_no_cutoff_breaks_its_bound_too_often(spark, make):
    """Ratios that say nothing about quality: no rule may reject many good documents."""
    docs, labels = labelled(spark, make, 1500)
    noise = labels.selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 5) > 0 as int) quality").where("doc_id is not null")
    got = q.verdicts(docs, noise).collect()
    assert sum(not r["kept"] for r in got) <= 0.08 * len(got)


def test_strata_without_labels_of_their_own_get_no_cutoffs(spark, make):
    """Cutoffs of well labelled languages must not fall on a rare or unseen one."""
    docs, labels = labelled(spark, make)
    small = (q.F.col("doc_id") % 40 == 0) & (q.F.col("doc_id") % 3 != 0)
    lang = q.F.when(small, "rare").when(q.F.col("doc_id") % 39 == 0, "unseen").otherwise(q.F.when(q.F.col("lang") == "en", "en"))
    got = {r["doc_id"]: r["kept"] for r in q.verdicts(docs.withColumn("lang", lang), labels).collect()}
    assert all(got[i] for i in range(3000) if (i % 40 == 0 and i % 3) or i % 39 == 0)
    assert not all(got[i] for i in range(0, 3000, 5))


def test_all_rules_together_keep_the_bound(spark):
    """Each ratio alone rejects 0.9 % of the good documents, all together 7 %."""
    names = [*q.COUNTS, *q.RATIOS]
    rows = []
    for i in range(20_000):
        bad, odd = i % 2 == 0, (i // 2) % 1000
        ratios = [float(c[0] / 1e3 if not bad and odd // 9 != k else c[0] * 10) for k, c in enumerate(q.RATIOS.values())]
        rows.append((i, "en", 100, 400, 0, 0, 0, *ratios))
    schema = "doc_id long, stratum string, " + ", ".join(f"{n} {'long' if n in q.COUNTS else 'double'}" for n in names)
    rules = q.certify(spark.createDataFrame(rows, schema), spark.range(20_000).selectExpr("id doc_id", "cast(id % 2 as int) quality"))
    good = [r for r in rows if r[0] % 2]
    assert sum(rules.rejects(r[1], r[7:]) for r in good) <= 0.01 * len(good)


def test_kept_against_plain_counting(spark, make):
    """The whole method once more in plain Python, on documents of two languages and none."""
    docs, labels = labelled(spark, make)
    flags = docs.select("doc_id", "lang", (q.F.pmod(q.F.xxhash64("doc_id", q.F.lit(5)), q.F.lit(q.PROPOSE)) == 0).alias("own"), "text").collect()
    quality = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            quality[r["doc_id"]] = min(r["quality"], quality.get(r["doc_id"], 9))
    rows = {r["doc_id"]: (r["lang"], r["own"], q.measure(r["text"])) for r in flags}
    usable = [(i, *rows[i]) for i in quality if not q.base_failed(rows[i][2][0], rows[i][2][4])]
    strata = {lang for i, lang, _, _ in usable if quality[i]}
    cutoffs = {}
    for lang in strata:
        mine = [(quality[i], own, m[5:]) for i, x, own, m in usable if x == lang]
        good = [m for v, own, m in mine if v and own]
        bad = [m for v, own, m in mine if not v]
        best = {}
        for k, cuts in enumerate(q.RATIOS.values()):
            gains = []
            for cut in cuts:
                out = sum(m[k] > cut for m in good)
                gains.append(sum(m[k] > cut for m in bad) - out if out <= q.ALPHA / len(q.RATIOS) * len(good) else -1)
            if max(gains) > 0:
                best[k] = gains.index(max(gains))
        tests = [m for v, own, m in mine if v and not own]
        for step in range(1, q.STEPS + 1):
            at = {k: list(q.RATIOS.values())[k][math.ceil(step * (b + 1) / q.STEPS) - 1] for k, b in best.items()}
            x, n = sum(any(m[k] > cut for k, cut in at.items()) for m in tests), len(tests)
            tail = sum(math.comb(n, j) * q.ALPHA**j * (1 - q.ALPHA) ** (n - j) for j in range(x + 1))
            if tail > q.DELTA / len(strata):
                break
            cutoffs[lang] = at
    assert len(cutoffs) == len(strata) == 2
    want = {i: not q.base_failed(m[0], m[4]) and not any(m[5 + k] > c for k, c in cutoffs.get(lang, {}).items()) for i, (lang, _, m) in rows.items()}
    assert {r["doc_id"]: r["kept"] for r in q.verdicts(docs, labels).collect()} == want


def test_five_hundred_strata(spark, make):
    docs, labels = labelled(spark, make)
    many = docs.withColumn("lang", q.F.concat(q.F.lit("l"), q.F.pmod("doc_id", q.F.lit(500))))
    got = q.verdicts(many, labels).collect()
    assert len(got) == 3000 and all(r["kept"] == (not r["base_failed"]) for r in got)  # a handful of labels certifies nothing
