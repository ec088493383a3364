"""Visible text of HTML pages: a tree with implied tags, rendered with block spacing, lists and aligned tables."""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import ship

# Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist select desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li summary".split())
#: A start tag closes an open element of these kinds, unless one of the fences lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
_COMMENT_START = re.compile(r"<!--.*\Z", re.DOTALL)
#: Between an open paragraph and a tag that would close it, these keep it open.
_STOPS = (BLOCK | frozenset("table td th li button".split())) - frozenset(["p"])
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_INTEGER = re.compile(r"\s*(-?\d{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    """Names and values of a start tag; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def is_hidden(raw: str) -> bool:
    """Has the attribute `hidden`, or a style whose last word is not to show the element."""
    low = raw.lower()
    if "hidden" not in low and "style" not in low:
        return False
    found = attributes(raw)
    if "hidden" in found:
        return True
    style: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", found.get("style", "")).lower().split(";"):
        name, _, value = part.partition(":")
        value, bang, _ = value.partition("!")
        name = name.strip()
        if bool(bang) >= style.get(name, (False, ""))[0]:
            style[name] = bool(bang), value.strip()
    return style.get("display", (0, ""))[1] == "none" or style.get("visibility", (0, ""))[1] == "hidden"


class Open:
    """The open elements, and of every kind their depths, so that no tag walks over all that is open."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}
        self.stops: list[int] = []

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _STOPS:
            self.stops.append(len(self.nodes))
        self.nodes.append(node)

    def _cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.depths[tag].pop()
            if tag in _STOPS:
                self.stops.pop()

    def nearest(self, tag: str) -> int:
        """Depth of the innermost open element of a kind, or 0."""
        found = self.depths.get(tag)
        return found[-1] if found else 0

    def close(self, tag: str) -> None:
        """Close the nearest open element of this kind; cells and rows are not closed from inside another table."""
        depth = self.nearest(tag)
        if depth and (tag == "table" or depth > self.nearest("table")):
            self._cut(depth)

    def imply(self, tag: str) -> None:
        """Close what a start tag closes without an end tag."""
        if tag in CLOSES_P and self.nearest("p") > (self.stops[-1] if self.stops else 0):
            self._cut(self.nearest("p"))
        if tag not in IMPLIED:
            return
        kinds, fences = IMPLIED[tag]
        fence = max(map(self.nearest, fences), default=0)
        inside = [d[at] for d in (self.depths.get(k, ()) for k in kinds) if (at := bisect.bisect_right(d, fence)) < len(d)]
        if inside:
            self._cut(min(inside))


def tree(source: str) -> Node:
    """The element tree; end tags without a start are ignored, missing ones are implied."""
    root = Node("#root")
    open_ = Open(root)
    at, last = 0, source.rfind(">")
    while at < len(source):
        # Behind the last ">" only a comment without an end can begin.
        found = _TAG.search(source, at) if at <= last else _COMMENT_START.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            open_.top.children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        if found.lastindex is None or found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            open_.close(tag)
            continue
        open_.imply(tag)
        node = Node(tag, found[3])
        open_.top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(source)
        elif tag not in VOID and not found[3].endswith("/"):
            open_.push(node)
    return root


class Writer:
    """Text with collapsed white space and requested breaks between blocks."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.prefix = 0, False, ""

    def gap(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def text(self, value: str, indent: str, pre: bool = False) -> None:
        if pre:
            value = value.replace("\r\n", "\n").replace("\r", "\n")
        else:
            if not value.strip(" \t\n\r\f"):
                self.space = self.space or bool(value)
                return
            lead = value[0] in " \t\n\r\f"
            trail = value[-1] in " \t\n\r\f"
            value = _SPACE.sub(" ", value).strip(" ")
            self.space = self.space or lead
        if not value:
            return
        if self.breaks or not self.out:
            if self.out:
                self.out.append("\n" * self.breaks)
            self.out.append(indent + self.prefix)
            self.breaks, self.prefix = 0, ""
        elif self.space:
            self.out.append(" ")
        self.out.append(value)
        self.space = not pre and trail

    def result(self) -> str:
        return "".join(self.out)


def aligned(rows: list[list[str]]) -> str:
    """Rows of cells, each column padded to its widest cell."""
    rows = [[" ".join(c.split()) for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    widths = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)).rstrip() for r in rows)


def render(source: str | None) -> str:
    """All visible text of a page; "" for null or a page without visible text.

    Works with a stack of its own, so nesting of any depth is fine.
    """
    writers, tables, lists = [Writer()], [], []
    pre = 0
    #: Whether text shows: inside svg only that of its text elements does.
    shown = [True]
    work: list[tuple[Node | str, bool]] = [(tree(source or ""), False)]
    while work:
        node, leaving = work.pop()
        own = writers[-1]
        indent = "  " * max(0, len(lists) - 1)
        if isinstance(node, str):
            if shown[-1]:
                own.text(node, indent, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if tag in HIDDEN or (node.attrs and is_hidden(node.attrs)):
                continue
            if tag == "br":
                own.gap(own.breaks + 1)
                continue
            if tag == "svg":
                shown.append(False)
            elif tag in ("text", "foreignobject") and len(shown) > 1:
                own.gap(1)
                shown.append(True)
            if tag == "table":
                tables.append([])
                lists.append(None)
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th", "caption") and tables:
                writers.append(Writer())
            elif tag in BLOCK:
                own.gap(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                start = _INTEGER.match(attributes(node.attrs).get("start", "")) if node.attrs else None
                lists.append(int(start[1]) if tag == "ol" and start else 1 if tag == "ol" else None)
            elif tag == "li":
                number = lists[-1] if lists else None
                own.prefix = "- " if number is None else f"{number}. "
                if lists and number is not None:
                    lists[-1] = number + 1
            elif tag == "pre":
                pre += 1
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if tag == "svg" or (tag in ("text", "foreignobject") and len(shown) > 1):
            shown.pop()
            if tag != "svg":
                own.gap(1)
        if tag == "table":
            lists.pop()
            text = aligned(tables.pop())
            if text:
                own.gap(2)
                own.text(text, "", True)
            own.gap(2)
        elif tag in ("td", "th", "caption") and tables:
            cell = writers.pop().result()
            if tag == "caption":
                tables[-1].insert(0, [cell])
            else:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append(cell)
        elif tag in BLOCK:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "pre":
                pre -= 1
            own.prefix = "" if tag == "li" else own.prefix
            own.gap(2 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 1)
    return writers[0].result()


def visible_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page, in one pass.

    A null or empty page gives an empty text, repeated rows one row each; other columns do not matter.
    """
    ship(pages.sparkSession)
    wanted = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            made = pa.array([render(h) for h in batch[1].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch[0], made], ["page_id", "text"])

    return wanted.mapInArrow(run, "page_id long, text string")
