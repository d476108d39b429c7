"""HTML extraction: pages rendered as text, by the layout that their tags imply.

A tree builder reads tags in order and keeps the stack of open elements, opening and closing those that
HTML implies (a paragraph ends where a block begins, a cell opens its row, ...). What it opens and closes
goes straight to a renderer, which leaves out what is not visible, collapses white space, and sets
blocks, lists and tables. No part of either recurses, so depth costs memory only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstone.llm._store import without


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Classes of elements in HTML.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
HIDDEN = _set("head script style title template noscript iframe noembed noframes object datalist audio video canvas svg math meta link base rp param source track")
SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr xmp")
BLOCK = SPACED | _set("html body div section article aside header footer nav main address form li dt dd tr caption thead tbody tfoot figcaption details summary legend option center hgroup menu dir textarea search")
ENDS_P = BLOCK - _set("option textarea html body caption tr thead tbody tfoot")
HEAD = _set("base link meta title style script template noscript")
#: What a start tag closes, if it is open nearer than what stands behind the bar.
IMPLIED = {
    "li": (_set("li"), _set("ul ol menu dir table td th")), "dt": (_set("dt dd"), _set("dl table td th")), "dd": (_set("dt dd"), _set("dl table td th")),
    "option": (_set("option"), _set("select datalist")), "optgroup": (_set("option optgroup"), _set("select")),
    "tr": (_set("tr td th caption colgroup"), _set("table")), "td": (_set("td th caption"), _set("table tr")), "th": (_set("td th caption"), _set("table tr")),
    "tbody": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table")), "thead": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table")), "tfoot": (_set("tbody thead tfoot tr td th caption colgroup"), _set("table")),
    "caption": (_set("caption"), _set("table")), "rt": (_set("rt rp"), _set("ruby")), "rp": (_set("rt rp"), _set("ruby")), "button": (_set("button"), _set("table td th")), "a": (_set("a"), _set("table td th")),
}

#: A name, and after "=" a quoted or a bare value; elsewhere a quote is a character like others.
_PAIR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_PAIR})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)?))?""")
_MAY_HIDE = re.compile("hidden|style", re.I)
#: Where a style's colons and semicolons part nothing.
_OPAQUE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^()]*\)", re.S)
_START = re.compile(r"\s*(-?\d{1,9})")
_SPAN = re.compile(r"\s*(\d{1,9})")
_WHITE = re.compile(r"[ \t\n\f\r]+")


def _attributes(text: str) -> dict[str, str]:
    """Names, in lower case, and values; of equal names the first."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _shows(tag: str, attributes: str) -> str:
    """"none" for an element that is left out with all it holds, by the hidden attribute, its display, or as a
    hidden input; else its own visibility, if it has one, which what it holds may change again. What aria-hidden
    keeps from screen readers is visible."""
    if not _MAY_HIDE.search(attributes):
        return ""
    found = _attributes(attributes)
    if "hidden" in found or (tag == "input" and found.get("type", "").strip().lower() == "hidden"):
        return "none"
    style: dict[str, tuple[bool, str]] = {}
    for part in _OPAQUE.sub("", found.get("style", "")).lower().split(";"):
        name, _, value = part.partition(":")
        value, important, _ = value.partition("!")
        if important or not style.get(name.strip(), (False,))[0]:
            style[name.strip()] = bool(important), value.strip()
    if style.get("display", (0, ""))[1] == "none":
        return "none"
    visibility = style.get("visibility", (0, ""))[1]
    return {"hidden": "hidden", "collapse": "hidden", "visible": "visible", "initial": "visible"}.get(visibility, "")


class _Flow:
    """Lines of one block flow: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False

    def text(self, text: str, pre: bool, prefix: str) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._put(first, prefix)
            for part in rest:
                self.end(keep=True)
                self._put(part, prefix)
            return
        parts = _WHITE.sub(" ", text)
        if parts == " " or not parts:
            self.space |= bool(self.line) and parts == " "
            return
        lead = (self.space or parts[0] == " ") and bool(self.line)
        self.space = parts[-1] == " "
        self._put((" " if lead else "") + parts.strip(" "), prefix)

    def _put(self, text: str, prefix: str) -> None:
        if not text:
            return
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(prefix)
        self.line.append(text)

    def end(self, keep: bool = False) -> None:
        if self.line or keep:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False


class _Table:
    def __init__(self):
        self.rows: list[list[str]] = []
        self.caption: list[str] = []
        self.down: dict[int, int] = {}  # rows that a cell above still covers, by column
        self.taken: set[int] = set()

    def row(self) -> None:
        self.rows.append([])
        self.taken = {c for c, n in self.down.items() if n > 0}
        self.down = {c: n - 1 for c, n in self.down.items() if n > 1}

    def cell(self, text: str, wide: int, high: int) -> None:
        if not self.rows:
            self.row()
        own = self.rows[-1]
        while len(own) in self.taken:
            own.append("")
        if high > 1:
            self.down |= {c: high - 1 for c in range(len(own), len(own) + wide)}
        own += [text, *[""] * (wide - 1)]

    def lines(self) -> list[str]:
        """Columns padded to their widest cell, two blanks apart; rows without text are left out."""
        rows = [r for r in self.rows if any(r)]
        width = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows), default=0))]
        return [*self.caption, *["  ".join(x.ljust(w) for x, w in zip(r, width, strict=False)).rstrip() for r in rows]]


class Renderer:
    """Takes the tree builder's events."""

    def __init__(self):
        self.flows, self.tables = [_Flow()], []
        self.veils: list[bool] = []  # of the open elements that have a visibility of their own
        self.hidden = self.pre = 0
        self.lists: list[list] = []
        self.marker = ""
        self.held: list[tuple] = []

    def open(self, tag: str, attributes: str) -> int:
        """0 if the element is left out with all that it holds, 2 if it has a visibility of its own, else 1."""
        shows = _shows(tag, attributes) if attributes and not self.hidden and tag not in HIDDEN else ""
        if self.hidden or tag in HIDDEN or shows == "none":
            self.hidden += tag not in VOID
            return 0
        if shows and tag not in VOID:
            self.veils.append(shows == "hidden")
        flow = self.flows[-1]
        if tag == "br":
            flow.end(keep=True) if flow.line else setattr(flow, "gap", True)
        elif tag in BLOCK:
            flow.end()
            flow.gap |= tag in SPACED and not (tag in ("ul", "ol") and self.lists)
        if tag in ("ul", "ol", "menu", "dir"):
            m = _START.match(_attributes(attributes).get("start", "")) if attributes else None
            self.lists.append([tag == "ol", int(m[1]) if m else 1])
        elif tag == "li":
            numbered, n = self.lists[-1] if self.lists else (False, 1)
            self.marker = f"{n}. " if numbered else "- "
            if self.lists:
                self.lists[-1][1] += 1
        elif tag in ("pre", "xmp", "textarea"):
            self.pre += 1
        elif tag == "table":
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in ("td", "th", "caption") and self.tables:
            found = _attributes(attributes) if attributes else {}
            spans = [int(m[1]) if (m := _SPAN.match(found.get(name, ""))) else 1 for name in ("colspan", "rowspan")]
            self.flows.append(_Flow())
            self.held.append((self.lists, min(max(1, spans[0]), 1000), spans[1] or 65534))
            self.lists = []
        return 2 if shows and tag not in VOID else 1

    def close(self, tag: str, shown: int) -> None:
        if not shown:
            self.hidden -= 1
            return
        if shown == 2:
            self.veils.pop()
        if tag in ("td", "th", "caption") and self.tables and len(self.flows) > 1:
            flow = self.flows.pop()
            flow.end()
            self.lists, wide, high = self.held.pop()
            text = " ".join(x for x in map(str.strip, flow.lines) if x)
            if tag == "caption":
                self.tables[-1].caption += [text] if text else []
            else:
                self.tables[-1].cell(text, wide, high)
            return
        flow = self.flows[-1]
        if tag in BLOCK:
            flow.end()
            flow.gap |= tag in SPACED and not (tag in ("ul", "ol") and len(self.lists) > 1)
        if tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag == "li":
            self.marker = ""
        elif tag in ("pre", "xmp", "textarea"):
            self.pre -= 1
        elif tag == "table" and self.tables:
            lines = self.tables.pop().lines()
            if lines:
                if flow.gap and flow.lines:
                    flow.lines.append("")
                flow.lines += lines
                flow.gap = True

    def text(self, text: str) -> None:
        if self.hidden or not text or (self.veils and self.veils[-1]):
            return
        flow = self.flows[-1]
        if self.tables and len(self.flows) <= len(self.tables) and not text.strip():
            return  # between rows
        prefix = ""
        if not flow.line and (self.pre or text.strip(" \t\n\f\r")):
            depth = "  " * max(0, len(self.lists) - 1)
            prefix = depth + (self.marker or ("  " if self.lists else ""))
            self.marker = ""
        flow.text(text, self.pre > 0, prefix)

    def result(self) -> str:
        self.flows[-1].end()
        return "\n".join(self.flows[0].lines).strip("\n")


def render(page: str) -> str:
    """All visible text of a page."""
    out, stack, at = Renderer(), [], 0
    count: Counter[str] = Counter()  # of open elements

    def pop() -> str:
        tag, shown = stack.pop()
        count[tag] -= 1
        out.close(tag, shown)
        return tag

    def push(tag: str, attributes: str = "") -> None:
        shown = out.open(tag, attributes)
        if tag not in VOID:
            stack.append((tag, shown))
            count[tag] += 1

    def near(wanted: frozenset[str], bound: frozenset[str]) -> int:
        """Place from the top of the nearest open wanted element, or 0."""
        if not any(count[t] for t in wanted):
            return 0
        for k in range(1, len(stack) + 1):
            tag = stack[-k][0]
            if tag in wanted:
                return k
            if tag in bound:
                return 0
        return 0

    cells, tables, one = _set("table td th caption"), _set("table"), {}
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            out.text(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                out.text(m[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = m[2].lower(), m[3]
        if not m[1]:
            if tag in ("html", "body") and any(t == tag for t, _ in stack[:3]):
                continue
            if tag == "body" or (tag not in HEAD | {"html", "head"} and stack and stack[-1][0] == "head"):
                while stack and stack[-1][0] == "head":
                    pop()
            if tag in IMPLIED:
                wanted, bound = IMPLIED[tag]
                while k := near(wanted, bound):
                    for _ in range(k):
                        pop()
            if tag in ENDS_P and (k := near(_set("p"), cells)):
                for _ in range(k):
                    pop()
            if tag in ("td", "th") and near(tables, frozenset()) and not near(_set("tr"), tables):
                push("tr")
            push(tag, attributes)
            if tag in RAW:
                end = one.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])", re.I)).search(page, at)
                body = page[at : end.start() if end else len(page)]
                out.text(html.unescape(body) if tag in ("textarea", "title") else body)
                at = end.start() if end else len(page)
            elif attributes.endswith("/") and tag in ("svg", "math"):
                pop()
        elif tag == "br":
            out.open("br", "")
        elif tag == "p" and not near(_set("p"), cells):
            push("p")
            pop()
        elif k := near(frozenset({tag}), cells - {tag} if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else cells) or (near(frozenset({tag}), tables - {tag}) if tag in ("tr", "tbody", "thead", "tfoot", "table") else 0):
            for _ in range(k):
                pop()
    while stack:
        pop()
    return out.result()


def extract_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the visible text of ``html_col`` in ``out``.

    Null and empty pages have an empty text, and so have pages that show nothing; text without tags is
    itself, with white space collapsed. Rows are rendered one by one: repeated rows give repeated rows,
    and an empty table an empty one. A column named ``out`` is replaced, others pass.
    """
    base = without(df, out)
    schema = base.select("*", F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [render(x.as_py() or "") for x in batch.column(html_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return base.mapInArrow(run, schema)
