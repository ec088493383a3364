"""Row-local text expressions. Every function maps a column to a column; none of them shuffles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: runs of white space, the Unicode white-space characters and the four separators before
# the blank.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# Fixed value: everything that is neither a letter, a number nor an underscore separates tokens.
NON_WORD = r"[^\p{L}\p{N}_]+"
# Fixed value: a token made of three or more ASCII letters.
ALPHA3 = "^[a-z]{3,}$"
# The characters removed from both ends of a text.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

ELLIPSIS = "…"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`.

    Inside a higher-order function a plain column expression would be evaluated once per element;
    a lambda argument is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove white space (not only blanks) from both ends."""
    return F.btrim(_col(text), F.lit(STRIP_CHARS))


def word_count(text: Column | str) -> Column:
    """Number of white-space separated words."""
    return F.size(F.array_remove(F.split(_col(text), WHITESPACE), ""))


def clean_symbol(symbol: Column | str) -> Column:
    """Dictionary key of a raw symbol: line breaks become blanks, ends are stripped, lower case."""
    return F.lower(strip(F.replace(_col(symbol), F.lit("\n"), F.lit(" "))))


def ellipsize(text: Column | str, limit: int = 600) -> Column:
    """Strip, and cut to `limit` characters with a trailing ellipsis only when longer."""
    return let(
        strip(text),
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(ELLIPSIS))
        ).otherwise(t),
    )


def snippet(text: Column | str, n: int) -> Column:
    """The first `n` characters followed by three dots, whatever the length of the text."""
    return F.concat(F.substring(_col(text), 1, n), F.lit("..."))


def slug(name: Column | str) -> Column:
    """Folder-friendly form of a display name."""
    spaced = F.replace(F.lower(_col(name)), F.lit(" "), F.lit("_"))
    return F.replace(spaced, F.lit("+"), F.lit("plus"))


def tokens(text: Column | str, mode: str = "word") -> Column:
    """Lower-cased tokens in text order; `alpha3` keeps tokens of three or more ASCII letters."""
    words = F.array_remove(F.split(F.lower(_col(text)), NON_WORD), "")
    if mode == "word":
        return words
    if mode == "alpha3":
        return F.filter(words, lambda w: w.rlike(ALPHA3))
    raise ValueError(f"unknown token mode {mode!r}")


def without(words: Column | str, stop_words: Sequence[str]) -> Column:
    """Drop the tokens that are in `stop_words`; the list becomes one hash set per task."""
    if not stop_words:
        return _col(words)
    return F.filter(_col(words), lambda w: ~w.isin(*stop_words))


def ngrams(words: Column | str, lo: int = 1, hi: int = 3) -> Column:
    """All runs of `lo`..`hi` consecutive tokens, joined by one blank."""

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(n)])
        )

    return let(_col(words), lambda t: F.concat(*[of_size(t, n) for n in range(lo, hi + 1)]))


def bag(words: Column | str) -> Column:
    """`array<struct<term, cnt>>` of one row's tokens.

    Sorting the tokens and measuring the runs keeps the counting inside the row, so no shuffle by
    (row, term) is needed.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(idx, lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), n) - p).cast("long").alias("cnt"),
                ),
            ),
        )

    return let(F.sort_array(_col(words)), runs)
