import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrascope.functions import text as tx

SAMPLES = [
    "one  two\tthree\n", "", "   ", "a b c", "don't stop", "snake_case x1", "Été déjà", "tab\x1csep",
    "日本語 テキスト", "A", "the the the", "end.",
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def python_tokens(text):
    return re.findall(r"\w+", text.lower())


def test_word_count_is_python_split(spark):
    rows = frame(spark, SAMPLES).select("text", tx.word_count("text").alias("n")).collect()
    assert [r["n"] for r in rows] == [len(r["text"].split()) for r in rows]


def test_every_white_space_character_splits(one):
    for c in tx.STRIP_CHARS:
        assert one(tx.word_count(F.lit(f"a{c}b{c}{c}c{c}"))) == 3, hex(ord(c))
    assert one(tx.word_count(F.lit("a\u200bb"))) == 1  # not white space


def test_tokens_are_word_runs(spark):
    rows = frame(spark, SAMPLES).select("text", tx.tokens("text").alias("t")).collect()
    assert [r["t"] for r in rows] == [python_tokens(r["text"]) for r in rows]


def test_alpha3_needs_word_bounds(one):
    got = one(tx.tokens(F.lit("The don't x1abc abc_d ABC étée cats ab"), "alpha3"))
    assert got == ["the", "don", "abc", "cats"]


def test_unknown_token_mode(one):
    with pytest.raises(ValueError):
        tx.tokens("text", "other")


def test_without(one):
    words = F.array(*[F.lit(w) for w in ("the", "cat", "the", "sat")])
    assert one(tx.without(words, ["the"])) == ["cat", "sat"]
    assert one(tx.without(words, [])) == ["the", "cat", "the", "sat"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_ngrams_of_short_texts(one, n):
    words = [f"w{i}" for i in range(n)]
    arr = F.array(*[F.lit(w) for w in words]) if n else F.array().cast("array<string>")
    want = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(n - k + 1)]
    assert one(tx.ngrams(arr)) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\n_1,.", max_size=30), min_size=1, max_size=20))
def test_bag_counts_tokens(spark, texts):
    rows = frame(spark, texts).select("text", tx.bag(tx.tokens("text")).alias("b")).collect()
    for r in rows:
        words = python_tokens(r["text"])
        assert {x["term"]: x["cnt"] for x in r["b"]} == {w: words.count(w) for w in words}


def test_clean_symbol(one):
    assert one(tx.clean_symbol(F.lit(" \tThe\nAnd\r\n"))) == "the and"
    assert one(tx.clean_symbol(F.lit(" Ice  Cream "))) == "ice  cream"


@pytest.mark.parametrize("n", [599, 600, 601])
def test_ellipsize_bounds(one, n):
    body = "x" * (n - 1) + "😀"
    got = one(tx.ellipsize(F.lit(" \n" + body + "\t ")))
    assert got == (body if n <= 600 else body[:600] + "…")


def test_snippet_and_slug(one):
    assert one(tx.snippet(F.lit("abc"), 20)) == "abc..."
    assert one(tx.snippet(F.lit("abcdef"), 3)) == "abc..."
    assert one(tx.slug(F.lit("Dramatic + Experiential"))) == "dramatic_plus_experiential"
