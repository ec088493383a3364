"""Personal data: patterns and loose generators propose spans, boosted trees score them, thresholds decide.

What the strict patterns find and check (Luhn, address parts, digit counts) always stays. The loose
generators also propose what the strict patterns cannot: numbers glued to others, other separators,
written-out addresses, IPv6. Each generator has its own check, and only a proposal that passes it can be
added. The trees judge format and context and know nothing of the checks: positives are checked finds, and
the same finds written in another way (an address with [at], an IPv6 address); negatives are proposals that
fail their check, and finds put into a context or a format that is none of their kind. Proposals that
pass but are no finds are scored. The trees learn from all examples of their part, and all of the held-out
part set a threshold per kind, by an exact bound on the share of negatives that it lets through. Examples
with the same features are one row with their number as its weight.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.sizing import broadcast_if_small
from narrascope.llm.common import ship, stored, working_on
from narrascope.llm.importance import kth_largest
from narrascope.llm.quality_rules import binomial_tail

KINDS = ("email", "ip", "card", "phone")
#: Share of the labelled proposals that set the thresholds; all others train.
HELD_OUT = 0.3
#: Share of negatives that a threshold may let through, and the chance that the held-out ones understate it.
MAX_FALSE, DOUBT = 0.02, 0.05
TREES, DEPTH = 20, 4
#: Bins of a feature, and the rows beyond which MLlib would choose their borders by a sample.
BINS, BIN_ROWS = 32, 10_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Fixed patterns; possessive where a shorter match can never succeed, so that long runs stay linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = r"\s?(?:\[at\]|\(at\)|\{at\}|\sat\s)\s?"
_DOT = r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s|\.\s?)"
_WRITTEN = re.compile(rf"(?i)([a-z0-9._%+-]{{1,64}}){_AT}([a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,4}})")
_HEX = r"[0-9A-Fa-f]{1,4}"
#: (kind, proposes, checks): every pattern bounds its repeats, so that long runs stay linear.
_LOOSE = (
    (0, re.compile(rf"(?i)(?<![\w.+-]){_WRITTEN.pattern[4:]}(?![\w-])"), "written"),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"), "dotted"),
    (1, re.compile(rf"(?<![0-9A-Za-z:.])(?:{_HEX}:{{1,2}}){{2,8}}(?:{_HEX})?(?![0-9A-Za-z:])"), "colons"),
    (2, re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])"), "card"),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ .\-/]?[0-9]{4}){2,3}(?:[ .\-/]?[0-9]{1,3})?(?![0-9])"), "card"),
    (3, re.compile(r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])"), "phone"),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|00[0-9]{1,3}|[0-9]{3})[ .\-/][0-9]{2,4}[ .\-/][0-9]{3,6}(?![0-9])"), "phone"),
)
_CUE = re.compile(r"(?i)mail|phone|tel|call|fax|mobile|card|visa|ip\b|addr|host|contact|write|reach|from|to\b")
_SECRET = re.compile(r"(?i)token|key|password|secret|hash|version|id\s*[:=]|build|order|serial")
Span = tuple[int, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: int, found: str) -> bool:
    """The check of a strict pattern on the text of a span."""
    if kind == 0:
        return True
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)
    number = digits(found)
    if kind == 2:
        return 12 <= len(number) <= 19 and luhn(number)
    return 9 <= len(number) <= 15


def is_written_address(found: str) -> bool:
    """A name, a written-out at, and a domain whose dots are all written out or all plain without blanks.

    A bare "at" between blanks needs a written-out dot: "stay at home. Then" is a sentence.
    """
    parts = _WRITTEN.fullmatch(found)
    if not parts:
        return False
    middle, domain = found[parts.end(1) : parts.start(2)], parts[2]
    bare = middle.strip().lower() == "at"
    written = re.search(r"(?i)[\[({]dot[\])}]|\sdot\s", domain) is not None
    labels = re.split(rf"(?i){_DOT}", domain)
    plain = "." in domain
    if re.search(r"\.\s", domain) or (bare and not written) or (written and plain):
        return False
    return labels[-1].isalpha() and len(labels[-1]) >= 2 and not any(x.startswith("-") or x.endswith("-") for x in labels)


def is_ipv6(found: str) -> bool:
    try:
        return found.count(":") >= 2 and ipaddress.IPv6Address(found) is not None
    except ValueError:
        return False


def checked(check: str, found: str) -> bool:
    """The check of a generator."""
    if check == "written":
        return is_written_address(found)
    if check == "colons":
        return is_ipv6(found)
    return passes({"dotted": 1, "card": 2, "phone": 3}[check], found)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with the run of allowed characters before it and a dotted domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of everything the strict patterns find and check, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        if kind < 3 or "+" in text:
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return sorted(out)


def describe(kind: int, found: str, before: str, after: str) -> list[float]:
    """Format of a span and its context, 24 characters before and 8 after; nothing that a check decides on."""
    groups = [len(g) for g in re.findall(r"[0-9]+", found)] or [0]
    letters = sum(c.isalpha() for c in found)
    return [
        *(float(kind == k) for k in range(4)), float(len(found)), float(sum(groups)), float(len(groups)), float(max(groups)), float(min(groups)),
        float(found[:1] == "+"), float(sum(c in "([{" for c in found)), float(sum(c in " .-/" for c in found)), float(found.count(":")),
        float(found.count("::")), letters / len(found), float(bool(re.search(r"[.!?]\s", found))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in tuple("\"'=:#_/")), float(before[-2:-1].isdigit()),
        float(after[:1] in tuple("\"':_/=")), float(bool(_CUE.search(before))), float(bool(_SECRET.search(before))),
    ]


def rewritten(kind: int, found: str, way: int) -> str:
    """The same personal data written as only a loose generator finds it."""
    number = digits(found)
    if kind == 0:
        at, dot = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."))[way % 4]
        name, _, domain = found.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == 1:
        parts = [int(p[-3:]) for p in found.split(".")]
        a, b = f"{parts[0]:x}{parts[1]:02x}", f"{parts[2]:x}{parts[3]:02x}"
        return (f"2001:db8:{a}:{b}:{b}:{a}:{parts[0]:x}:{parts[3]:x}", f"fe80::{a}:{b}:{parts[1]:x}:{parts[2]:x}", f"2a02:{a}::{b}")[way % 3]
    if kind == 2:
        return (number, "/".join(number[i : i + 4] for i in range(0, len(number), 4)), ".".join(number[i : i + 4] for i in range(0, len(number), 4)))[way % 3]
    return (f"({number[:3]}) {number[3:6]}-{number[6:10]}", f"00{number[:2]} {number[2:5]} {number[5:10]}", f"+{number[:2]}.{number[2:5]}.{number[5:8]}.{number[8:12]}")[way % 3]


def misplaced(found: str, before: str, after: str, way: int) -> tuple[str, str, str]:
    """(text, before, after) of a find inside an identifier, or as a secret or a version."""
    if way % 2:
        return found, before[-20:] + "k3f", "b2" + after[:6]
    return found, before[-14:] + ("token = ", "version ", "build id:")[way // 2 % 3], after


def spoilt(kind: int, found: str, way: int) -> str:
    """Something of a like form that is no personal data."""
    number = digits(found) or "7"
    if kind == 0:
        return ("look at " + found.split("@")[-1].split(".")[0] + ". Then", found.split("@")[0] + " at noon. It")[way % 2]
    if kind == 1:
        return (":".join(f"{len(found):02d}" for _ in range(3)), "0a:1b:2c:" + ":".join(number[i] + "f" for i in range(3)))[way % 2]
    if kind == 2:
        return (number + "77", f"{number[:4]}-{number[4:6]}-{number[6:8]} {number[8:12]}")[way % 2]
    return (f"{number[:4]}-{number[4:6]}-{number[6:8]}", f"{number[:3]}.{number[3:5]}.{number[5:9]}")[way % 2]


def proposals(text: str, base: list[Span]) -> Iterator[tuple[int, int, int, int | None, list[float]]]:
    """(start, kind, end, label, features) of examples and proposals.

    A find is a positive, and so is the find rewritten; one of them misplaced, and the find spoilt, are
    negatives. A proposal beside the finds is a negative if it fails its generator's check, else it has no
    label and waits for its score.
    """
    for start, kind, end in base:
        found, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
        yield start, kind, end, 1, describe(kind, found, before, after)
        other, way = rewritten(kind, found, start), start + end
        yield start, kind, end, 1, describe(kind, other, before, after)
        yield start, kind, end, 0, describe(kind, *misplaced((found, other)[way // 2 % 2], before, after, way))
        yield start, kind, end, 0, describe(kind, spoilt(kind, found, way), before, after)
    seen = set(base)
    for kind, pattern, check in _LOOSE:
        for m in pattern.finditer(text):
            start, end = m.span()
            if (start, kind, end) in seen or any(s < end and start < e for s, _, e in base):
                continue
            seen.add((start, kind, end))
            label = None if checked(check, m.group()) else 0
            yield start, kind, end, label, describe(kind, m.group(), text[max(0, start - 24) : start], text[end : end + 8])


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([*_SPAN, pa.field("label", pa.int64()), pa.field("features", pa.list_(pa.float64()))])
_ANY = re.compile(r"(?i)[0-9@:]|\bat\b")


def _proposed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text_key, base spans and proposals of every document."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))

    def run(batches):
        working_on("spans")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            base, found = [], []
            for t in batch[1].to_pylist():
                some = bool(t) and _ANY.search(t) is not None
                spans = base_spans(t) if some else []
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                names = ("start", "kind", "end", "label", "features")
                found.append([dict(zip(names, p, strict=True)) for p in proposals(t, spans)] if some else [])
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, batch[0], batch[2], pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))],
                ["row", "doc_id", "text_key", "base", "found"],
            )

    span = "start:long,kind:long,end:long"
    schema = f"row long, doc_id long, text_key long, base array<struct<{span}>>, "
    return wanted.mapInArrow(run, schema + f"found array<struct<{span},label:long,features:array<double>>>")


def _examples(found: DataFrame) -> DataFrame:
    """kind, label, features, held (sets the thresholds), n: all labelled proposals, alike ones in one row."""
    # All examples made from one find are on the same side of the split.
    draw = F.pmod(F.xxhash64("row", "start", F.lit(7)), F.lit(1_000_000)) / 1e6
    labelled = found.where("label is not null").withColumn("held", draw < HELD_OUT)
    return labelled.groupBy("kind", "label", "features", "held").agg(F.count(F.lit(1)).alias("n"))


def _thresholds(held: DataFrame, max_false: float) -> dict[int, float]:
    """Per kind the lowest score that is known to let through at most `max_false` of the negatives.

    `held` has kind, label, score and n, the number of held-out examples. So many negatives may reach the
    score that "more than `max_false` do" falls at level `DOUBT` by the exact binomial test; with too few
    negatives even none says nothing, and the kind gets no threshold.
    """
    sizes = {(r["kind"], r["label"]): r["n"] for r in held.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for kind in range(4):
        n = sizes.get((kind, 0), 0)
        # The test cannot fall this low beyond the mean.
        counts = np.arange(min(n, math.ceil(n * max_false) + 1))
        allowed = int((binomial_tail(counts, n, max_false) <= DOUBT).sum()) if n else 0
        if allowed and sizes.get((kind, 1)):
            negatives = held.where((F.col("kind") == kind) & (F.col("label") == 0))
            # Of the sorted negatives, those before this one may reach the threshold.
            last = kth_largest(negatives.select(F.col("score").alias("key"), "n"), allowed, weight="n")
            out[kind] = float(np.nextafter(last, 2))
    return out


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_false: float = MAX_FALSE) -> DataFrame:
    """Per document: doc_id, text_key, `base` spans and all `spans`, each an array of (start, kind, end) in order.

    Offsets are code points, end exclusive; kinds are numbers in the order of `KINDS`. One pass over the
    texts; after that only spans and their features move. All labelled proposals train the trees or set the
    thresholds, as a hash says; all proposals that pass their check and do not overlap a find are scored. Kinds with too few held-out negatives for the bound, as in small or empty
    tables, add nothing. A null or empty text has no spans; repeated rows give one row each.
    """
    rows = stored(_proposed(docs, id_col, text_col), "pii-proposals")
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    known = stored(_examples(found), "pii-examples").withColumn("v", array_to_vector("features"))
    limits: dict[int, float] = {}
    training = known.where("not held")
    n_rows, n_labels = training.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if n_labels == 2:
        # MLlib looks at all rows for the borders of bins up to the square of their number.
        bins = BINS if n_rows <= BIN_ROWS else math.isqrt(n_rows) + 1
        trees = GBTClassifier(featuresCol="v", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=1)
        model = trees.fit(training.select("v", "label", "n"))
        scores = model.transform(known.where("held")).withColumn("score", vector_to_array("probability")[1])
        limits = _thresholds(stored(scores.groupBy("kind", "label", "score").agg(F.sum("n").alias("n")), "pii-scores"), max_false)
    if not limits:
        return rows.select("doc_id", "text_key", "base", F.col("base").alias("spans"))
    # Only proposals apart from the finds can be added; spoilt copies lie on them and are left out.
    open_ = found.where("label is null").withColumn("v", array_to_vector("features"))
    passed = F.lit(False)
    for kind, limit in limits.items():
        passed = passed | ((F.col("kind") == kind) & (vector_to_array("probability")[1] >= limit))
    added = model.transform(open_).where(passed).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    spans = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.slice("base", 1, 0)))))
    return rows.join(added, "row", "left").select("doc_id", "text_key", "base", spans.alias("spans"))


def listed(spans) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"], s["end"])), ","
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per kind and digest of the base spans, and the list of all spans."""
    counts = [_count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _count(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str, spans: list[dict]) -> str:
    """`text` with [EMAIL], [IP], [CARD] or [PHONE] for each span; overlapping spans become one, named by the first."""
    out, end = [], 0
    for s in spans:
        if s["start"] >= end:
            out += [text[end : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        end = max(end, s["end"])
    return "".join(out) + text[end:]


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """`docs`, all columns, with all spans replaced in the text; a column n_chars follows the new length.

    The spans of texts that have any are joined by a hash of the text: broadcast if their measured size
    allows it, else by a shuffle.
    """
    found = stored(find(docs, id_col=id_col, text_col=text_col, **limits).where("size(spans) > 0"), "pii-spans")
    found = found.groupBy("text_key").agg(F.first("spans").alias("_pii_spans")).withColumnRenamed("text_key", "_pii_key")
    marked = docs.withColumn("_pii_key", F.xxhash64(F.col(text_col).cast("string")))
    marked = marked.join(broadcast_if_small(found), "_pii_key", "left").select(*docs.columns, "_pii_spans")
    at, columns = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            spans, old = batch.column("_pii_spans").to_pylist(), batch.column(at).to_pylist()
            new = [redacted(t, s) if s else t for t, s in zip(old, spans, strict=True)]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in columns:
                i = columns.index("n_chars")
                kept = batch.column(i).to_pylist()
                sizes = [len(t) if s else k for t, s, k in zip(new, spans, kept, strict=True)]
                arrays[i] = pa.array(sizes, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return marked.mapInArrow(run, docs.schema)
