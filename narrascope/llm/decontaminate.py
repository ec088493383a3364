"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of a text."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import ship, texts, utf8, working_on

WINDOW = 10
#: Characters of window text in one automaton; a larger benchmark is scanned in several of them.
PART_CHARS = 4_000_000
_NORMAL = bytes(
    32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start:long,end:long>>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all characters from U+0080 on."""
    return utf8(text).translate(_NORMAL).split()


def joined(words: list[bytes]) -> str:
    """Words between single spaces, one character per byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def item_windows(text: str | None, width: int = WINDOW) -> Iterator[tuple[int, str]]:
    """(number of words, joined words) of every window of an item; a short item is one window."""
    words = normal_words(text)
    width = min(width, len(words))
    if width:
        for i in range(len(words) - width + 1):
            yield width, joined(words[i : i + width])


def parts_of(benchmark: DataFrame, id_col: str, text_col: str, width: int, part_chars: int) -> list:
    """Broadcast parts of the benchmark's windows, each of about `part_chars` characters at most.

    The driver holds one part at a time, so a larger benchmark means more parts, not more memory.
    """
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out, part, size = [], {}, 0
    for row in rows.where("id is not null and text is not null").toLocalIterator():
        for n, window in item_windows(row["text"], width):
            if size and size + len(window) > part_chars:
                out.append(context.broadcast(part))
                part, size = {}, 0
            size += len(window)
            part.setdefault(window, (n, []))[1].append(row["id"])
    if part:
        out.append(context.broadcast(part))
    return out


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(part) -> ahocorasick.Automaton:
    """The automaton of a part; a worker keeps the last few."""
    if part.id not in _built:
        built = ahocorasick.Automaton()
        for window, (n, items) in part.value.items():
            built.add_word(window, (n, sorted(set(items))))
        built.make_automaton()
        while len(_built) >= 4:
            _built.pop(next(iter(_built)))
        _built[part.id] = built
    return _built[part.id]


class Part:
    """A broadcast with a name of its own."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def scan(words: list[bytes], parts: list) -> tuple[np.ndarray, set[str]]:
    """Positions of the hit words, ascending, and the items with occurring windows."""
    text, ends, items = joined(words), [], set()
    for part in parts:
        for end, (n, found) in automaton(part).iter(text):
            ends.append((end, n))
            items.update(found)
    if not ends:
        return np.zeros(0, np.int64), items
    hit = np.zeros(len(words) + 1, np.int64)
    end, n = np.array(ends, np.int64).T
    last = np.cumsum(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)[end] - 1
    np.add.at(hit, last - n, 1)
    np.add.at(hit, last, -1)
    return np.flatnonzero(np.cumsum(hit)[:-1]), items


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets of the text before normalisation, end exclusive."""
    place = [m.span() for m in _WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": place[r[0]][0], "end": place[r[-1]][1]} for r in runs]


def _row(doc_id, text, parts: list) -> tuple:
    words = normal_words(text)
    hit, items = scan(words, parts) if words else (np.zeros(0, np.int64), set())
    names = sorted(items)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    spans = original_spans(text, hit) if len(hit) else []
    return doc_id, len(words), len(hit), len(names), digest, len(hit) > 0, names, spans


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, and hit spans of the original text.

    A window is `width` consecutive words of an item (all words of a shorter one); a word is hit inside
    any occurrence. One pass, no shuffle: the windows are broadcast in parts of `part_chars` characters
    and every text is scanned once per part. A null or wordless text has no words and no hits; items
    with null id or text have no windows; items that share a window all count; repeated rows of
    `docs` give one row each; with an empty benchmark nothing is hit.
    """
    parts = [Part(b) for b in parts_of(benchmark, item_col, item_text_col, width, part_chars)]

    def run(batches):
        working_on("spans")
        for batch in batches:
            rows = [_row(d, t, parts) for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
            )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", width: int = WINDOW, part_chars: int = PART_CHARS
) -> DataFrame:
    """The rows of `docs`, all columns, whose text has no hit word. One pass, no shuffle."""
    ship(docs.sparkSession)
    parts = [Part(b) for b in parts_of(benchmark, "item_id", "text", width, part_chars)]
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            words = map(normal_words, batch.column(at).to_pylist())
            clean = [not w or not len(scan(w, parts)[0]) for w in words]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
