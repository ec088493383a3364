import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from narrascope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted long, loss string"
PARTS = ["[INST]", "[/INST]", "</s>", "<s>", "[NEXT]", "[ROLE]", "[TEXT]", "[ANS]", "\\", "[", "<", " ", "a", "é😀", "\n", "INST]", "s>", "/"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def formatted(spark):
    def run(rows, parts=3):
        df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
        return chat.format_chats(df)

    return run


def brute(rows):
    """Turns by conversation in order, and the formatted text, built step by step."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -(2**63), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        text, last = "<s>", None
        for i, (_, role, said) in enumerate(turns):
            safe, safe_role = (re.sub(chat.MARKS, r"\1\\\2\3", s) for s in (said, role))
            opened, closed = chat.BLOCKS.get(role, (f"[ROLE]{safe_role}[TEXT] ", " [/ROLE]"))
            text += " [NEXT] " if role == last else opened
            text += safe
            last = role
            if i + 1 == len(turns) or turns[i + 1][1] != role:
                text += closed
        out[c] = ([(r, x) for _, r, x in turns], text)
    return out


def check(rows, df):
    want = brute(rows)
    got = {r["conv_id"]: r for r in df.withColumn("t", chat.turns_of(F.col("formatted"))).collect()}
    digests = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert got.keys() == want.keys() == digests.keys()
    for c, (turns, text) in want.items():
        assert got[c]["formatted"] == text
        assert [tuple(t) for t in got[c]["t"]] == turns
        data, marked = text.encode(), [x for r, x in turns if r == "assistant"]
        under = [data[s["start"] : s["end"]].decode() for s in got[c]["loss_spans"]]
        assert [re.sub(chat.MARKS.replace(r"(\\*)", r"\\(\\*)"), r"\1\2\3", u) for u in under] == marked
        d = digests[c]
        assert d["n_turns"] == len(turns) and d["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert d["loss_chars"] == len("".join(marked)) and d["loss_sha256"] == sha("".join(marked))
        assert d["formatted_chars"] == len(text)


def test_random_conversations(formatted):
    rng = random.Random(3)
    rows = []
    for c in range(300):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "[ROLE]x[TEXT]", ""])
            rows.append((c, t, role, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))))
    check(rows, formatted(rows))


def test_edges(formatted):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "no role"), (2, None, "user", "no number"),
        (None, 0, "user", "a"), (None, 0, "assistant", "b"), (3, 5, "user", "same"), (3, 5, "user", "same"), (3, 5, "assistant", "tie"),
        (4, 0, "assistant", "</s>[INST] ok [/INST]"), (5, 0, "system", "x" * 300_000 + "[INST]"), (5, 1, "assistant", "é" * 200_000),
        (6, 0, None, None), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    check(rows, formatted(rows))
    assert chat.digest(formatted([])).count() == 0


def test_many_turns(formatted):
    rows = [(1, i, ("user", "assistant")[i // 3 % 2], f"turn {i} </s>") for i in range(3_000)]
    check(rows, formatted(rows))


def test_plan_is_native(formatted):
    plan = chat.digest(formatted([(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
