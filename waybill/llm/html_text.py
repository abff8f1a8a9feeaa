"""Visible text of HTML pages, laid out as a reader sees it.

A tokenizer feeds a stack of open elements that closes elements whose end tags are
implied and ignores stray ones. Hidden parts are left out. Text flows into lines: block
elements begin new lines, paragraphs and headings keep a blank line, lists are marked
and indented, preformatted text keeps its line ends, and the cells of a table are
aligned in columns. Elements are handled as they come, without recursion, so deeply
nested pages are safe; a table is the largest part held before it is laid out.

Defined results: a null page gives a null text, an empty one an empty text; broken markup
never fails; repeated rows get equal texts; other columns are not carried.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column

# fixed values: element names by their role in HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set(
    "head title script style template noscript iframe object audio video canvas svg math "
    "datalist select".split()
)
MARGIN = set(  # a blank line before and after
    "p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset".split()
)
BLOCK = MARGIN | set(  # a line of their own
    "html body address article aside center dd details dialog div dir dt figcaption footer form "
    "header hgroup legend li main menu nav optgroup option search section summary "
    "caption tr thead tbody tfoot td th".split()
)
LISTS = {"ul", "ol", "menu", "dir"}
ROWS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
# a start tag of the key closes open elements of these names, up to one of the barriers
CLOSES = {
    "li": ({"li"}, LISTS | CELLS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"} | CELLS),
    "dd": ({"dt", "dd"}, {"dl", "table"} | CELLS),
    "td": (CELLS, {"table"}),
    "th": (CELLS, {"table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": (ROWS | {"caption"}, {"table"}),
    "tbody": (ROWS | {"caption"}, {"table"}),
    "tfoot": (ROWS | {"caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
# an end tag does not close through these
BARRIERS = CELLS | {"table", "caption"}
_SPACES = re.compile(r"[ \t\n\r\f]+")
_CUT_TAG = re.compile(r"<[A-Za-z/][^<>]*\Z")  # a tag that the page ends in is not shown
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def width(text: str) -> int:
    """Columns that the text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF")
        for c in text
    )


class Flow:
    """Lines of text under one container (the page or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0  # blank lines wanted before the next line
        self.space = False  # a collapsed space is pending
        self.indent = 0
        self.mark = ""  # list mark of the next line

    def text(self, data: str) -> None:
        words = _SPACES.sub(" ", data)
        if not words or words == " ":
            self.space = self.space or bool(words)
            return
        if self.parts and (self.space or words[0] == " "):
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words.strip(" "))

    def raw(self, data: str) -> None:
        """Preformatted text."""
        first, *rest = data.expandtabs(8).split("\n")
        self.parts.append(first)
        for line in rest:
            self.flush(keep=True)
            self.parts.append(line)

    def flush(self, keep: bool = False) -> None:
        """End the line. ``keep`` writes it even when it is empty."""
        line = "".join(self.parts)
        self.parts, self.space = [], False
        if not line and not keep:
            return
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        mark, self.mark = self.mark, ""
        lead = " " * (self.indent - len(mark)) + mark if mark else " " * self.indent
        self.lines.append((lead + line).rstrip())

    def margin(self) -> None:
        self.flush()
        self.gap = 1 if self.lines else 0

    def result(self) -> list[str]:
        self.flush()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []
        self.caption: list[str] = []

    def cell(self, lines: list[str], span: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append((lines, span))

    def lines(self) -> list[str]:
        """Cells padded to the width of their column, two spaces between columns."""
        wide: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for lines, span in row:
                if span == 1:
                    wide[at] = max(wide.get(at, 0), *map(width, lines), 0)
                at += span
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for lines, _ in row), default=0)):
                line, at, due = "", 0, 0
                for lines, span in row:
                    cell = lines[i] if i < len(lines) else ""
                    line += " " * (due - width(line)) + cell
                    due = max(due, width(line) if cell and span > 1 else 0)
                    due += 0 if span > 1 else wide.get(at, 0) + 2
                    if span > 1:
                        due = sum(wide.get(k, 0) + 2 for k in range(at + span))
                    at += span
                out.append(line.rstrip())
        return out


class Page(HTMLParser):
    """Open elements and the flows that their text goes to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # name, hides its content
        self.open: dict[str, int] = {}
        self.hidden = 0
        self.pre = 0
        self.fresh = False  # nothing of a preformatted element was shown yet
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.spans: list[int] = []
        self.lists: list[int | None] = []  # next number, None for marks

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in CLOSES:
            self._close_upto(*CLOSES[tag])
        if tag in BLOCK and self.open.get("p"):
            self._close_upto({"p"}, BARRIERS | {"button"})
        if tag in CELLS and self.tables and not self._inside("tr"):
            self.handle_starttag("tr", [])
        if tag in VOID:
            if not self.hidden:
                self._void(tag, named)
            return
        style = named.get("style") or ""
        hides = (
            tag in HIDDEN
            or "hidden" in named
            or (tag == "dialog" and "open" not in named)
            or bool(style and _INVISIBLE.search(style))
        )
        self.stack.append((tag, hides))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += hides
        if not self.hidden:
            self._begin(tag, named)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing

    def handle_endtag(self, tag):
        if tag == "p" and not self.open.get("p"):
            if not self.hidden:
                self.flow.margin()  # a stray end of paragraph is an empty paragraph
        elif tag == "br":
            self.handle_starttag("br", [])
        elif self.open.get(tag):
            self._close_upto({tag}, BARRIERS - {tag} if tag not in {"table"} else set())

    def handle_data(self, data):
        if self.hidden:
            return
        if self.pre:
            # the line end right after the start tag is not shown
            self.flow.raw(data[1:] if self.fresh and data[:1] == "\n" else data)
            self.fresh = False
        elif not (self.tables and len(self.flows) <= len(self.tables)):
            self.flow.text(data)
        elif data.strip():  # text between cells is shown before the table
            self.flow.text(data)

    def _inside(self, name: str) -> bool:
        """Whether an element is open above the innermost table."""
        for tag, _ in reversed(self.stack):
            if tag == name:
                return True
            if tag == "table":
                return False
        return False

    def _close_upto(self, names, barriers) -> None:
        """Close open elements down to the innermost of ``names``, if no barrier is above."""
        if not any(self.open.get(n) for n in names):
            return
        depth = None
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in names:
                depth = i
                break
            if tag in barriers:
                return
        while depth is not None and len(self.stack) > depth:
            self._pop()

    def _pop(self) -> None:
        tag, hides = self.stack.pop()
        self.open[tag] -= 1
        if not self.hidden:
            self._end(tag)
        self.hidden -= hides

    def _void(self, tag, named) -> None:
        if tag == "br":
            self.flow.flush(keep=True)
        elif tag == "hr":
            self.flow.margin()
        elif tag == "img" and (named.get("alt") or "").strip():
            self.flow.text(named["alt"])

    def _begin(self, tag, named) -> None:
        flow = self.flow
        if tag in LISTS:
            # a list inside a list keeps no blank line
            flow.flush() if self.lists else flow.margin()
            start = (named.get("start") or "1").strip()
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            self.lists.append(number if tag == "ol" else None)
            flow.indent += 4
        elif tag in MARGIN and tag != "table":
            # the first block of an item stays on the line of its mark
            flow.flush() if flow.mark else flow.margin()
        elif tag in BLOCK and tag not in CELLS:
            flow.flush()
        if tag == "li":
            number = self.lists[-1] if self.lists else None
            flow.mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif tag in ("blockquote", "dd"):
            flow.indent += 4
        elif tag == "pre":
            self.pre += 1
            self.fresh = True
        elif tag == "table":
            flow.margin()
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif (tag in CELLS or tag == "caption") and self.tables:
            self.flows.append(Flow())
            span = (named.get("colspan") or "1").strip()
            self.spans.append(min(1000, int(span)) if re.fullmatch(r"[1-9]\d{0,5}", span) else 1)

    def _end(self, tag) -> None:
        flow = self.flow
        if (tag in CELLS or tag == "caption") and self.tables and self.spans:
            lines, span = self.flows.pop().result(), self.spans.pop()
            if tag == "caption":
                self.tables[-1].caption = lines
            else:
                self.tables[-1].cell(lines, span)
            return
        if tag == "table" and self.tables:
            flow.flush()
            for line in self.tables.pop().lines():
                flow.parts.append(line)
                flow.flush(keep=True)
            flow.margin()
            return
        if tag == "pre":
            self.pre -= 1
        if tag in LISTS and self.lists:
            flow.flush()
            self.lists.pop()
            flow.indent -= 4
            if not self.lists:
                flow.margin()
            return
        if tag == "li":
            flow.flush()
            flow.mark = ""
            return
        if tag in ("blockquote", "dd"):
            flow.flush()
            flow.indent -= 4
        if tag in MARGIN:
            flow.margin()
        elif tag in BLOCK:
            flow.flush()

    def finish(self) -> str:
        self.close()
        while self.stack:
            self._pop()
        lines = self.flows[0].result()
        return "\n".join(lines).strip("\n")


def visible_text(html: str) -> str:
    """Text that a browser shows of the page."""
    page = Page()
    html = html.replace("\r\n", "\n").replace("\x00", "\ufffd")
    page.feed(_CUT_TAG.sub("", html))
    return page.finish()


def page_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def render(pages: pa.Array) -> pa.Array:
        return pa.array(
            [None if h is None else visible_text(h) for h in pages.to_pylist()], pa.string()
        )

    return render(html)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) of every page."""
    rows = pages.select(column(key).alias("key"), column(html).cast("string").alias("html"))
    return rows.select("key", page_text(F.col("html")).alias("text")).withColumnRenamed("key", key)
