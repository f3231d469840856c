"""Layout-aware text of HTML pages (operator 7).

A tree builder with implied end tags reads the tokens of the standard parser;
visibility rules drop what a browser does not show (head matter, scripts, hidden and
collapsed elements, closed dialogs and details, definitions in svg, comments) and,
though it is shown, aria-hidden elements, textarea contents and select options; the
renderer emits every other visible text with blank lines between blocks, list marks
and numbers, kept line breaks in preformatted text, values of buttons and text
fields, and table cells aligned to columns, spans included.

Null html gives null; empty or broken html gives the text that can be read.
Nesting is followed without recursion, and an open element is found by its name, so
time is linear in the page at any depth.  Lists are indented up to INDENTS levels,
columns padded up to PADDED characters, and in tables within more than NESTED tables
cells stand below each other, so that layout stays linear too; text is never cut.  Repeated rows give equal texts, empty tables an empty result; extra
columns are carried through, one of the result's name is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from specforge.llm.common import batch_of, column, fresh

# --- fixed values: element classes of the HTML standard -------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object canvas audio video "
                   "datalist select option textarea noframes".split())
# Unseen in svg or math; of svg itself only these elements show text.
FOREIGN_UNSEEN = frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient filter "
                           "annotation annotation-xml".split())
SVG_TEXT = frozenset({"text", "foreignobject"})
# Inputs that show their value, and parts of formulas that stand apart.
VALUED = frozenset("text search email url tel number button submit reset".split())
APART = frozenset("mfrac mroot mtable mtr".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary "
                   "table ul caption tr thead tbody tfoot legend center".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol menu dl pre table figure".split())
# A start tag of the first kind ends an open element of the second, up to a border.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "tr", "thead", "tbody", "tfoot", "caption", "legend"}
# Their start tags close all such elements up to the border, whatever lies between.
TABULAR = frozenset("tr td th thead tbody tfoot".split())
FOREIGN = frozenset({"svg", "math"})
# Elements of FOREIGN that hold HTML, and start tags that end FOREIGN.
HTML_POINTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                     "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SCOPE = frozenset({"table", "td", "th", "caption", "html", "button", "object", "template"})
MOST_COLUMNS, MOST_ROWS = 1000, 65534
# --------------------------------------------------------------------------------------
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
LISTS = frozenset({"ul", "ol", "menu"})
INDENTS, PADDED, NESTED = 32, 80, 16
SPACE = re.compile(r"[ \t\n\f\r]+")


class Element:
    """`seen` is false where nothing inside shows, `shown` null where visibility is inherited."""

    __slots__ = ("tag", "items", "start", "seen", "shown", "closed", "wide", "high")

    def __init__(self, tag: str, start: int = 1, seen: bool = True):
        self.tag, self.start, self.seen = tag, start, seen
        self.shown: bool | None = None
        self.closed, self.wide, self.high = False, 1, 1
        self.items: list[Element | str] = []


def _number(value: str | None, least: int, most: int) -> int:
    """A span attribute; one where it is no number or below the least."""
    value = (value or "").strip()
    if not re.fullmatch(r"[0-9]{1,9}", value):
        return 1
    return min(int(value), most) if int(value) >= least else 1


class Builder(HTMLParser):
    """Tokens to a tree; end tags that the standard lets out are supplied."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.open = [self.root]
        # Positions in `open` below the root, by tag, ascending.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.foreign = False    # whether the page has svg or math

    def _push(self, e: Element) -> None:
        self.places[e.tag].append(len(self.open))
        self.open.append(e)

    def _cut(self, k: int) -> None:
        """Close the open elements from position k on."""
        while len(self.open) > k:
            self.places[self.open.pop().tag].pop()

    def _last(self, tags) -> int:
        """The position of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, tags, borders) -> None:
        k = self._last(tags)
        if k and k > self._last(borders):
            # The outermost such element that directly holds the others.
            while k > 1 and self.open[k - 1].tag in tags:
                k -= 1
            self._cut(k)

    def _close_all(self, tags, borders) -> None:
        border = self._last(borders)
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, border)) < len(p)]
        if found:
            self._cut(min(found))

    def _foreign(self) -> int:
        """The position of the open svg or math whose rules hold here, or 0."""
        border = self._last(HTML_POINTS)
        return min((p[k] for t in FOREIGN if (p := self.places.get(t)) and (k := bisect_right(p, border)) < len(p)), default=0)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in BREAKOUT and self.foreign and (at := self._foreign()):
            self._cut(at)
        if tag in FOREIGN:
            self.foreign = True
        if tag in TABULAR:
            self._close_all(*IMPLIED[tag])
        elif tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self._last({"table"}) > self._last({"tr"}):
            self.handle_starttag("tr", [])
        if tag in ENDS_P or tag in ("li", "dd", "dt"):
            self._close({"p"}, SCOPE | {"li", "dd", "dt"} if tag in ("li", "dd", "dt") else SCOPE)
        if tag not in UNSEEN and self.open[-1].tag == "head" and tag not in VOID:
            self._cut(len(self.open) - 1)
        e = self._element(tag, dict(attrs))
        self.open[-1].items.append(e)
        if tag not in VOID:
            self._push(e)

    def _element(self, tag: str, values: dict) -> Element:
        style = {k.lower(): v.lower() for k, v in STYLE.findall(values.get("style") or "")}
        inner = self.foreign and tag in FOREIGN_UNSEEN and self._last(FOREIGN)
        unseen = (tag in UNSEEN or inner or "hidden" in values or values.get("aria-hidden") == "true"
                  or style.get("display") == "none" or tag == "dialog" and "open" not in values)
        start = values.get("start") or "1"
        e = Element(tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, not unseen)
        e.shown = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility"))
        e.closed = tag == "details" and "open" not in values
        if tag in ("td", "th"):
            e.wide = _number(values.get("colspan"), 1, MOST_COLUMNS)
            e.high = _number(values.get("rowspan"), 0, MOST_ROWS)
        elif tag == "input" and (values.get("type") or "text").lower() in VALUED and values.get("value"):
            e.items.append(values["value"])
        return e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # Only svg, math and what is in them can close themselves.
        if self.foreign and tag not in VOID and self.open[-1].tag == tag:
            e = self.open[-1]
            self._cut(len(self.open) - 1)
            if tag not in FOREIGN and not self._foreign():
                self._push(e)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.open[-1].items.append(Element("br"))
            return
        k = self._last({tag})
        if not k:
            return
        # A stray end tag does not leave the table cell it stands in.
        if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "table", "body") and self._last(("td", "th", "table")) > k:
            return
        self._cut(k)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].items.append(data)


class Page:
    """Output lines of a subtree: words flow into a line, blocks end it."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False      # a blank line is due before the next text
        self.space = False      # a blank is due before the next word
        self.mark = ""          # list mark for the next line
        self.prefix = ""        # indentation

    def word(self, text: str) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.prefix + self.mark)
            self.mark = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def text(self, data: str, kept: bool) -> None:
        if kept:
            for k, part in enumerate(data.split("\n")):
                if k:
                    if self.line:
                        self.end()
                    elif self.lines:
                        self.lines.append("")
                if part:
                    self.word(part)
            return
        if data[:1] in " \t\n\f\r" and data:
            self.space = bool(self.line)
        flat = SPACE.sub(" ", data).strip(" ")
        if flat:
            self.word(flat)
            self.space = data[-1] in " \t\n\f\r"

    def end(self, spaced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.blank = self.blank or spaced


class Frame:
    """An element being rendered, with what it inherits from those around it."""

    __slots__ = ("e", "at", "out", "state", "kept", "shown", "art", "drawn", "owner", "item", "depth", "row", "table", "tables", "summary")

    def __init__(self, e: Element, out: Page, up: Frame | None = None):
        self.e, self.at, self.out, self.state, self.summary = e, 0, out, None, False
        self.kept = e.tag == "pre" or up is not None and up.kept
        self.shown = e.shown if e.shown is not None else up is None or up.shown
        # Whether bare text is not drawn: in svg, outside its text elements.
        self.art = e.tag == "svg" or up is not None and up.art and e.tag not in SVG_TEXT
        self.tables = 0 if up is None else up.tables + (e.tag == "table")
        # Set apart like a block: text elements of svg, cells that are not aligned.
        self.drawn = up is not None and (e.tag == "text" and up.art or e.tag in ("td", "th") and up.tables > NESTED)
        # The list, row and table it stands in, and whether a list item is open around it.
        self.owner = up and (up if up.e.tag in LISTS else up.owner)
        self.item = up is not None and (up.item or up.e.tag == "li")
        self.depth = 0 if up is None else up.depth + (up.e.tag in LISTS)
        self.row = None if e.tag == "table" or self.tables > NESTED else e if e.tag == "tr" else up and up.row
        self.table = up and (up if up.e.tag == "table" else up.table)


def render(root: Element) -> str:
    """The visible text of a tree."""
    page = Page()
    stack = [Frame(root, page)]
    results: dict[int, list] = {}
    while stack:
        frame = stack[-1]
        e, out = frame.e, frame.out
        if frame.at == 0:
            _open(frame)
        if frame.at < len(e.items):
            item = e.items[frame.at]
            frame.at += 1
            if isinstance(item, str):
                if frame.shown and not frame.art and not e.closed and (
                        e.tag not in ("table", "tr", "thead", "tbody", "tfoot", "ul", "ol") or item.strip()):
                    out.text(item, frame.kept)
                continue
            if not item.seen:
                continue
            if e.closed:
                # Of closed details the first summary shows.
                if item.tag != "summary" or frame.summary:
                    continue
                frame.summary = True
            if item.tag == "br":
                out.end()
            elif item.tag in VOID and item.tag != "hr":
                if item.items and (frame.shown if item.shown is None else item.shown):
                    out.text(f" {item.items[0]} ", False)
            elif item.tag in ("td", "th") and frame.row is not None:
                cell = Page()
                results.setdefault(id(frame.row), []).append((item, cell))
                stack.append(Frame(item, cell, frame))
            else:
                stack.append(Frame(item, out, frame))
            continue
        stack.pop()
        if e.tag == "tr" and id(e) in results:
            row = []
            for item, cell in results.pop(id(e)):
                cell.end()
                row.append((item.wide, item.high, [x for x in cell.lines if x] or [""]))
            if frame.table is None:
                out.end()
                for _, _, lines in row:
                    out.lines += lines
            else:
                frame.table.state.append(row)
        elif e.tag in ("thead", "tbody", "tfoot") and frame.table is not None:
            frame.table.state.append(None)
        elif e.tag == "table":
            _table(frame.state or [], out)
        _close(frame)
        if stack and stack[-1].e.tag in APART and out.line:
            out.space = True
    page.end()
    return "\n".join(page.lines).strip("\n")


def _open(frame: Frame) -> None:
    e, out = frame.e, frame.out
    if e.tag in BLOCKS or frame.drawn:
        out.end(e.tag in SPACED and not (e.tag in LISTS and frame.item))
    if e.tag in ("thead", "tbody", "tfoot") and frame.table is not None:
        frame.table.state.append(None)
    if e.tag in LISTS:
        frame.state = (out.prefix, e.start)
        out.prefix += "  " if 0 < frame.depth <= INDENTS else ""
    elif e.tag == "li":
        owner = frame.owner
        if owner is not None and owner.e.tag == "ol":
            out.mark = f"{owner.state[1]}. "
            owner.state = (owner.state[0], owner.state[1] + 1)
        else:
            out.mark = "- "
    elif e.tag == "table":
        frame.state = []


def _close(frame: Frame) -> None:
    e, out = frame.e, frame.out
    if e.tag in LISTS:
        out.end(frame.state[0] == "" and out.prefix == "")
        out.prefix = frame.state[0]
    elif e.tag in BLOCKS or frame.drawn:
        out.end(e.tag in SPACED)
    if e.tag == "li":
        out.mark = ""


def _places(rows: list) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (column, end column, lines); cells that reach down push later ones to the right.

    A null row ends a group of rows and with it all spans over rows.
    """
    out: list = []
    down: dict[int, tuple[int, float]] = {}     # start column: end column, last row
    for row in rows:
        if row is None:
            down = {}
            continue
        at, placed, n = 0, [], len(out)
        for wide, high, lines in row:
            while at in down and down[at][1] >= n:
                at = down[at][0]
            placed.append((at, at + wide, lines))
            if high != 1:
                down[at] = (at + wide, n + high - 1 if high else float("inf"))
            at += wide
        out.append(placed)
    return out


def _table(rows: list, out: Page) -> None:
    """Cells as columns of equal width, two blanks apart; a cell's lines below each other."""
    out.end()
    placed = [row for row in _places(rows) if row]
    if not placed:
        return
    if out.blank and out.lines:
        out.lines.append("")
    out.blank = False
    starts = sorted({at for row in placed for at, _, _ in row})
    widths = [0] * len(starts)
    cells = [(bisect_left(starts, at), bisect_left(starts, end), min(PADDED, max(map(len, lines))))
             for row in placed for at, end, lines in row]
    for k, end, wide in cells:
        if end <= k + 1:
            widths[k] = max(widths[k], wide)
    for k, end, wide in cells:
        # What a spanning cell needs beyond its columns widens the last of them.
        if end > k + 1:
            widths[end - 1] += max(0, wide - sum(widths[k:end]) - 2 * (end - 1 - k))
    offsets, total = {}, 0
    for at, wide in zip(starts, widths, strict=True):
        offsets[at] = total
        total += wide + 2
    for row in placed:
        for line in range(max(len(lines) for _, _, lines in row)):
            parts, length = [], 0
            for at, _, lines in row:
                if line < len(lines) and lines[line]:
                    gap = max(offsets[at] - length, 2 if length else 0)
                    parts += [" " * gap, lines[line]]
                    length += gap + len(lines[line])
            out.lines.append((out.prefix + "".join(parts)).rstrip())


def page_text(html: str) -> str:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract(df: DataFrame, html: str = "html", name: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the visible text of each page."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != name.lower()]
    read = fresh(df, "html_source")
    source = df.select(*kept, F.col(html).alias(read))
    schema = to_arrow_schema(source.schema).remove(len(kept)).append(pa.field(name, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else page_text(t) for t in (x.as_py() for x in column(batch, read))]
            yield batch_of(schema, [*batch.columns[:-1], out])

    return source.mapInArrow(run, from_arrow_schema(schema))
