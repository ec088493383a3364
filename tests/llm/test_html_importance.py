import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from narrascope.llm import html_render, importance


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<b>a</b> b<i>c</i>", "a bc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"), ("<h1>T</h1>x<ul><li>a<li>b</ul>y", "T\n\nx\n\n- a\n- b\n\ny"),
        ("<ol start=3><li>c<ul><li>d</ul><li>e</ol>", "3. c\n  - d\n4. e"),
        ("<table><tr><th>n<th>long name<tr><td>22<td>b</table>", "n  | long name\n22 | b"),
        ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a x | y | b"),
        ("a<script>if (a<b) {'</p>'}</script>b<style>p{}</style>c", "abc"), ("<title>no</title><body>yes", "yes"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"), ("<!-- no --><p>a<!-- > -->b", "ab"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"), ("</div></p>a</b>", "a"), ("<p>a <a href=\"x>y\">link</a>", "a link"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"), ("a < b <", "a < b <"), ("<select><option>no</select>yes", "yes"),
    ],
)
def test_render(source, text):
    assert html_render.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<div class="hidden md:flex">a</div>', "a"), ('<p class="x hidden y">a</p>', "a"), ('<p title="the hidden truth">a</p>', "a"),
        ('<p data-x="display:none">a</p>', "a"), ("<p HIDDEN=''>no</p>b", "b"), ("<p style='display:none;display:block'>a", "a"),
        ("<ol data-start=7 class='start=5'><li>a</ol>", "1. a"), ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
        ("<svg><title>no</title><desc>no</desc>no<text>a <tspan>b</tspan></text><text>c</text></svg>d", "a b\nc\nd"),
    ],
)
def test_only_real_attributes_hide_and_drawings_keep_their_text(source, text):
    assert html_render.render(source) == text


def test_deep_and_broken_pages():
    assert html_render.render("<div>" * 50_000 + "x") == "x"
    assert html_render.render("<table><tr><td>" * 300 + "x").strip() == "x"
    rng = random.Random(1)
    parts = ["<", ">", "<p", "</", "<table>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "x", " ", '"', "'", "<!--", "-->", "<script>", "=", "&", "<pre>"]
    for _ in range(3000):
        html_render.render("".join(rng.choice(parts) for _ in range(30)))


def test_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "u", "")]
    got = html_render.visible_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "a"), (1, "a"), (2, ""), (None, "")]


def labelled(spark, make):
    rng = random.Random(5)
    fine, foul = [f"f{i}" for i in range(300)], [f"x{i}" for i in range(20)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        words = [rng.choice(fine) for _ in range(60)] + [rng.choice(foul) for _ in range(5 * bad)]
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(bad)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_the_sample_is_like_the_target(spark, make):
    docs, labels = labelled(spark, make)
    got = importance.resample(docs, labels, keep=0.7).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(got) == 1200 and len(kept) == 840
    assert sum(i % 4 == 0 for i in kept) < 30


def test_edges(spark, make, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = importance.resample(make(edge_rows), none).collect()
    assert len(got) == len(edge_rows) and all(r["kept"] and r["log_weight"] == 0 for r in got)
    assert importance.resample(make([]), none).count() == 0


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=3000)] + [0.5] * 500 + [-7.0, 9.0]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 500, 1200, 3501, 3502):
        want = sorted(values, reverse=True)[k - 1] if k < len(values) else float("-inf")
        assert importance.kth_largest(keys, k, limit=50) == want


def test_weights_against_plain_counting(spark, make, edge_rows):
    """Counts, ratio and weight of every document from dictionaries, its own counts left out."""
    docs, labels = labelled(spark, make)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()][:200] + [(5_000 + i, t) for i, (_, t) in enumerate(edge_rows)]
    aims = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.collect()}
    bags = [Counter(importance.buckets_of(t, 1 << 10).tolist()) for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), bag in zip(rows, bags, strict=True):
        raw.update(bag)
        target.update(bag if aims.get(i) else {})
    want = {}
    for (i, _), bag in zip(rows, bags, strict=True):
        own, n = bool(aims.get(i)), sum(bag.values())
        share = (sum(target.values()) - n * own) / max(1, sum(raw.values()) - n)
        want[i] = sum(t * math.log((target[b] - t * own + 8) / ((raw[b] - t) * share + 8)) for b, t in bag.items())
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample(make(rows), labels, buckets=1 << 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * (1 + abs(want[i])) for i in want)


@pytest.mark.parametrize(
    "page",
    ["<span><div>" * 90_000, "</b>" * 250_000, "<body>" * 160_000, "<a " * 330_000, "<b><table>" + "<span>" * 80_000 + "</b>" * 100_000, "<span>" * 80_000 + "<hr>" * 100_000],
    ids=["nested", "stray ends", "bodies", "no end", "fenced ends", "rules"],
)
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    html_render.tree(page + "x")
    assert time.perf_counter() - start < 5


def test_empty_table_and_clashing_columns(spark):
    schema = "page_id long, html string, text string, node string"
    assert html_render.visible_text(spark.createDataFrame([], schema)).count() == 0
    got = html_render.visible_text(spark.createDataFrame([(1, "<p>a", "t", "n")], schema)).collect()
    assert [tuple(r) for r in got] == [(1, "a")]
