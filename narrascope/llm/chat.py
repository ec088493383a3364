"""Conversations as one training text each, with a loss mask, by Spark expressions only.

The turns of a conversation are collected and sorted, neighbours of the same role become one block, and
the blocks are concatenated:

    <s>[SYS] text [/SYS][INST] text [NEXT] text [/INST][ANS] text</s>[ROLE]tool[TEXT] text [/ROLE]

A text that holds one of these marks gets a backslash behind the mark's first character, and one more
where backslashes stand there already, so that the output can be cut at its marks and read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template. Blanks belong to a mark.
BEGIN, NEXT = "<s>", " [NEXT] "
BLOCKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")}
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "[ROLE]", "[TEXT] ", " [/ROLE]"
TRAINED = "assistant"
#: What an escaped mark looks like: first character, backslashes, the rest. No rest holds a first character.
MARKS = r"([\[<])(\\*)((?:/?(?:INST|SYS|ROLE)|ANS|NEXT|TEXT)\]|/?s>)"
_CLOSES = r" \[/SYS\]| \[/INST\]|</s>| \[/ROLE\]"
#: Turns whose lengths are summed in one go; sums over longer conversations are put together from these.
CHUNK = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKS.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def bound(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(values: Column) -> Column:
    """The sum of all values before each one, and last of all."""
    return F.aggregate(
        values, F.array(F.lit(0).cast("long")), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + v))
    )


def running(values: Column) -> Column:
    """Sums of all values before each one, in chunks so that long arrays are not copied for every value."""

    def over(values):
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / CHUNK).cast("int") - 1), lambda i: F.slice(values, i * CHUNK + 1, CHUNK))
        inside = F.transform(chunks, _sums)
        return bound(inside, lambda parts: bound(_sums(F.transform(parts, lambda p: F.element_at(p, -1))), lambda starts: F.flatten(
            F.transform(parts, lambda p, i: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(starts, i)))
        )))

    return bound(values, over)


def blocks(turns: Column) -> Column:
    """Neighbouring turns of one role as (role, texts)."""

    def merged(turns):
        first = F.filter(
            F.sequence(F.lit(0), F.size(turns) - 1),
            lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, F.greatest(i - 1, F.lit(0)))["role"]),
        )
        ends = F.concat(first, F.array(F.size(turns)))

        def block(ends):
            return F.transform(
                F.slice(ends, 1, F.size(ends) - 1),
                lambda start, i: F.struct(
                    F.get(turns, start)["role"].alias("role"),
                    F.transform(F.slice(turns, start + 1, F.get(ends, i + 1) - start), lambda t: t["text"]).alias("texts"),
                ),
            )

        return bound(ends, block)

    return bound(turns, merged)


def _by_role(role: Column, which: int, other: Column) -> Column:
    out = F.when(role == "system", F.lit(BLOCKS["system"][which]))
    for name in ("user", "assistant"):
        out = out.when(role == name, F.lit(BLOCKS[name][which]))
    return out.otherwise(other)


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def pieces(blocks: Column) -> Column:
    """Marks and texts in output order as (text, loss); the loss is on the assistant's texts alone."""
    plain = F.lit(False)

    def one(b):
        role = b["role"]
        opened = _by_role(role, 0, F.concat(F.lit(OTHER_OPEN), escaped(role), F.lit(OTHER_TEXT)))
        said = F.transform(
            b["texts"],
            lambda t, i: F.when(i == 0, F.array(_piece(escaped(t), role == TRAINED))).otherwise(
                F.array(_piece(F.lit(NEXT), plain), _piece(escaped(t), role == TRAINED))
            ),
        )
        closed = _by_role(role, 1, F.lit(OTHER_CLOSE))
        return F.concat(F.array(_piece(opened, plain)), F.flatten(said), F.array(_piece(closed, plain)))

    return F.concat(F.array(_piece(F.lit(BEGIN), plain)), F.flatten(F.transform(blocks, one)))


def _output(pieces: Column) -> Column:
    def made(pieces):
        sizes = F.transform(pieces, lambda p: F.octet_length(p["text"]).cast("long"))
        spans = bound(running(sizes), lambda starts: F.transform(pieces, lambda p, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.octet_length(p["text"])).alias("end"), p["loss"].alias("loss")
        )))
        trained = F.transform(
            F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
        )
        return F.struct(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("formatted"), trained.alias("loss_spans"))

    return bound(pieces, made)


def format_chats(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (start and end in UTF-8 bytes of formatted, end exclusive).

    One shuffle of the turns by conversation; the largest conversation has to fit a row, as its output
    does. Turns go by number, then role, then text, a null number first. A null or empty text is an
    empty text with marks around it, a null role an empty one, rows without a conversation id form one
    conversation without id. Repeated rows are turns of their own. An empty table has no output.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return collected.select("conv_id", _output(pieces(blocks(F.col("turns")))).alias("made")).select("conv_id", "made.*")


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, found by its marks."""

    def parsed(block):
        known = [F.when(F.startswith(block, F.lit(opened)), F.struct(F.lit(name).alias("role"), F.lit(len(opened)).alias("skip"))) for name, (opened, _) in BLOCKS.items()]
        at = F.instr(block, OTHER_TEXT)
        name = unescaped(F.substring(block, F.lit(len(OTHER_OPEN) + 1), at - 1 - len(OTHER_OPEN)))
        head = F.coalesce(*known, F.struct(name.alias("role"), (at - 1 + len(OTHER_TEXT)).alias("skip")))
        return bound(head, lambda h: F.transform(
            F.split(F.substring(block, h["skip"] + 1, F.length(block)), r" \[NEXT\] ", -1),
            lambda t: F.struct(h["role"].alias("role"), unescaped(t).alias("text")),
        ))

    body = F.substring(formatted, F.lit(len(BEGIN) + 1), F.length(formatted))
    return bound(F.split(body, _CLOSES, -1), lambda found: F.flatten(F.transform(F.slice(found, 1, F.size(found) - 1), parsed)))


def trained_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return bound(formatted.cast("binary"), lambda data: F.array_join(F.transform(
        loss_spans, lambda s: unescaped(F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))
    ), ""))


def digest(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from their text and their mask."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select(
        "conv_id",
        turns_of(F.col("formatted")).alias("turns"),
        trained_text(F.col("formatted"), F.col("loss_spans")).alias("trained"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )
