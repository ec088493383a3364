"""Token counts by greedy longest match, one step per character: a trie with failure links.

Every node of the vocabulary trie knows how many pieces are finished when its match cannot go on
(`pops`) and the node that stands for what is left over (`fail`). A word is counted without backing up
and without building a piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from narrascope.llm.common import Kept, texts, utf8, working_on

#: Stands before every word of a text in the vocabulary file.
WORD_START = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in kept]


class PieceCounter(Kept):
    """Counts of words; a frequent word met before is only looked up, up to `limit` bytes of them.

    Characters that are no piece themselves count one token per UTF-8 byte and end the match before
    them; pieces that hold such a character are left out.
    """

    def __init__(self, pieces: Iterable[str], limit: int = 160 << 20):
        super().__init__(limit)
        pieces = set(pieces)
        self.single = {p for p in pieces if len(p) == 1}
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            if not self.single.issuperset(piece):
                continue
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                at = self.next[at][c]
            ends[at] = True
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        todo = deque([0])
        while todo:
            above = todo.popleft()
            for c, at in self.next[above].items():
                todo.append(at)
                if ends[at]:
                    self.pops[at] = 1
                    continue
                # The piece found so far ends above; what is left over is matched from its failure node on.
                left, pops = self.fail[above], self.pops[above]
                while c not in self.next[left]:
                    pops += self.pops[left]
                    left = self.fail[left]
                self.fail[at], self.pops[at] = self.next[left][c], pops

    def __missing__(self, word: str) -> int:
        value = self.count(word)
        self.keep(word, value)
        return value

    def count(self, word: str) -> int:
        total, at = 0, 0
        for c in word:
            if c not in self.single:
                while at:
                    total += self.pops[at]
                    at = self.fail[at]
                total += len(c.encode("utf-8", "surrogatepass"))
                continue
            while c not in self.next[at]:
                total += self.pops[at]
                at = self.fail[at]
            at = self.next[at][c]
        while at:
            total += self.pops[at]
            at = self.fail[at]
        return total


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    working_on("pieces")
    if path not in _counters:
        _counters[path] = PieceCounter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens of the whole text, in one pass without a shuffle.

    Words are runs without ASCII white space, each with the word-start mark before it. A null or empty
    text has neither words nor tokens; repeated rows give one row each.
    """
    path = model or default_path()

    def run(batches):
        for batch in batches:
            known = counter(path)
            words = [utf8(t).split() for t in batch[1].to_pylist()]
            counts = [
                sum(map(known.__getitem__, (WORD_START + w.decode("utf-8", "surrogatepass") for w in ws))) for ws in words
            ]
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array([len(w) for w in words], pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
