"""Visible text of web pages, rendered with their layout.

A scanner finds tags, a builder makes a tree and supplies tags that may be left out (a paragraph ends
where a block begins, a list item where the next one does, cells get a row), visibility rules drop what a
browser would not show, and a renderer writes the rest: blocks on lines of their own, paragraphs set apart by
a blank line, list items with their mark and indent, preformatted text as it stands, table cells aligned in
columns. All visible text is kept, navigation and footers included.

Not shown: scripts, styles, templates, the head, noscript, elements with the hidden attribute or with
display:none, text under visibility:hidden, closed details but for the summary, closed dialogs, comments, what stands in
for audio, video, canvas, frames and objects with data, the parts of drawings that are not text, annotations of formulas.

Elements may be nested without limit: the builder finds open tags by their places, and the renderer's calls wait on a list
of their own. Some bounds concern the layout alone: lists and quotations are indented up to MAX_INDENT columns, cells of
tables within MAX_TABLES tables are lines of their own instead of columns, and a cell reaches over 1,000 rows and columns at most.

Defined results: null and empty pages give the empty text; an unfinished tag or comment at the end hides the
rest, as in a browser; repeated rows are rendered row by row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator
from html import unescape
from typing import Any

from pyspark.sql import DataFrame

from .common import map_rows, utf8

#: Columns are aligned up to this width; a longer cell sticks out.
MAX_COLUMN = 60
#: Widest indent of lists and quotations, and tables within tables that are laid out in columns.
MAX_INDENT, MAX_TABLES = 80, 12

#: Classes of tags of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = set("head title script style template noscript datalist meta link base iframe noembed noframes audio video canvas desc defs metadata symbol annotation annotation-xml".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure hr fieldset".split())
PLAIN = set("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav ol optgroup option search section summary tbody td text foreignobject tfoot th thead tr ul caption".split())
ENDS_P = (SPACED | PLAIN) - set("body html td th tr tbody thead tfoot caption option optgroup legend text foreignobject".split())
#: An opened tag ends these open ones, unless one of the bounds is opened within.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, set()),
}
ENDS["thead"] = ENDS["tfoot"] = ENDS["tbody"]
#: End tags don't reach out of these.
WALLS = {"td", "th", "table", "caption", "template", "button"}
TABLE_PARTS = set("table thead tbody tfoot tr td th caption".split())
LISTS = {"ul", "ol", "menu", "dir"}

MARKUP = re.compile(r"""<!--(?:>|->|.*?--!?>|.*)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|</[^a-zA-Z>][^>]*>|</>|</?[a-zA-Z].*""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLANK = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def number(self, name: str, default: int, most: int = 10**9) -> int:
        digits = re.match(r"\s*(-?\d{1,9})", self.attributes.get(name, ""))
        return min(int(digits[1]), most) if digits else default


class TreeBuilder:
    """A tree of elements and strings, with tags supplied that a page left out."""

    def __init__(self) -> None:
        self.root = Element("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag

    def innermost(self, tags: set[str]) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        places = self.places
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Ends the element at this place and those within."""
        for element in self.stack[place:]:
            self.places[element.tag].pop()
        del self.stack[place:]

    def end_open(self, tags: set[str], bounds: set[str]) -> None:
        """Ends the outermost of the open `tags` that lies within the bounds."""
        held = [at for t in tags if (at := self.places.get(t))]
        if held:
            bound = self.innermost(bounds)
            within = [at[i] for at in held if (i := bisect_right(at, bound)) < len(at)]
            if within:
                self.cut(min(within))

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag in ENDS_P:
            self.end_open({"p"}, WALLS)
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.push(Element("tr"), False)
        self.push(Element(tag, attributes), closed and bool(self.places.get("svg") or self.places.get("math")))

    def push(self, element: Element, closed: bool) -> None:
        """An element below the innermost open one; `closed`: by its own tag, as only drawings and formulas have it."""
        self.stack[-1].children.append(element)
        if element.tag not in VOID and not closed:
            self.places[element.tag].append(len(self.stack))
            self.stack.append(element)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        place = self.innermost({tag})
        if place and (tag in TABLE_PARTS or self.innermost(WALLS) <= place):
            self.cut(place)
        elif tag == "p":
            self.stack[-1].children.append(Element("p"))

    def text(self, text: str) -> None:
        if text:
            self.stack[-1].children.append(unescape(text) if "&" in text else text)


def parse(page: str) -> Element:
    build, at, size = TreeBuilder(), 0, len(page)
    while at < size:
        found = MARKUP.search(page, at)
        if not found:
            build.text(page[at:])
            break
        build.text(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            build.end(tag)
            continue
        given = found[3]
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(given)} if given and not given.isspace() else {}
        build.start(tag, attributes, given.endswith("/"))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = close.start() if close else size
            content = page[at:end]
            if tag in ("textarea", "title", "xmp"):
                build.text(content if tag != "xmp" else content.replace("&", "&amp;"))
            at = end
    return build.root


class Scope:
    """A list item or quotation whose lines are under way: the columns before it, its mark, its first line's place."""

    __slots__ = ("columns", "mark", "first", "gap", "written")

    def __init__(self, columns: int, mark: str, first: int) -> None:
        self.columns, self.mark, self.first, self.gap, self.written = columns, mark, first, 0, False


class Flow:
    """Lines of text under way."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is not at its end
        self.scopes = [Scope(0, "", 0)]

    def put(self, text: str) -> None:
        """Text whose white space collapses."""
        text = BLANK.sub(" ", text)
        if text.startswith(" ") and (not self.parts or self.parts[-1][-1] in " \n"):
            text = text[1:]
        if text:
            self.parts.append(text)

    def put_as_is(self, text: str) -> None:
        for i, x in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.end_line(True)
            if x:
                self.parts.append(x)

    def end_line(self, even_empty: bool = False) -> None:
        line = "".join(self.parts).rstrip(" \t")
        self.parts.clear()
        if line or even_empty:
            self.add(line)

    def add(self, line: str) -> None:
        """A line; blank ones before the first of a scope go. The first line in a scope has its mark, and the gap of the scope around."""
        scopes = self.scopes
        if not line:
            if scopes[-1].written:
                self.lines.append(line)
            return
        n = len(scopes)
        while n and not scopes[n - 1].written:
            n -= 1
        if n:
            self.lines += [""] * scopes[n - 1].gap
            scopes[n - 1].gap = 0
        for scope in scopes[n:]:
            scope.gap, scope.written = 0, True
        before = scopes[n].columns if n < len(scopes) else self.columns()
        self.lines.append(" " * before + "".join([x.mark for x in scopes[n:]]) + line)

    def columns(self) -> int:
        return min(MAX_INDENT, self.scopes[-1].columns + len(self.scopes[-1].mark))

    def block(self, margin: int) -> None:
        self.end_line()
        self.scopes[-1].gap = max(self.scopes[-1].gap, margin)

    def enter(self, mark: str) -> None:
        self.scopes.append(Scope(self.columns(), mark, len(self.lines)))

    def leave(self) -> None:
        """Ends a scope, without the blank lines at its end."""
        self.end_line()
        scope = self.scopes.pop()
        while len(self.lines) > scope.first and not self.lines[-1]:
            self.lines.pop()

    def done(self) -> list[str]:
        self.leave()
        return self.lines


#: A call of the renderer: it yields the calls that it waits for and is sent what they return.
Call = Generator["Call", Any, Any]


def finish(call: Call) -> Any:
    """What a call returns. Waiting calls are on a list, so pages may be nested as deep as they are."""
    waiting, value = [call], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as end:
            waiting.pop()
            value = end.value
    return value


class Setting:
    """What holds for an element's content: whether it is visible, stands as it is, lists and tables around, and whether it is a drawing's."""

    __slots__ = ("visible", "as_is", "lists", "tables", "drawn")

    def __init__(self, visible: bool = True, as_is: bool = False, lists: int = 0, tables: int = 0, drawn: bool = False) -> None:
        self.visible, self.as_is, self.lists, self.tables, self.drawn = visible, as_is, lists, tables, drawn

    def within(self, element: Element) -> Setting:
        visible, tag = self.visible, element.tag
        if "style" in element.attributes and (rule := VISIBILITY.search(element.attributes["style"])):
            visible = rule[1].lower() == "visible"
        drawn = tag == "svg" or (self.drawn and tag not in ("text", "foreignobject"))
        as_is = (self.as_is and tag != "table") or tag in ("pre", "xmp", "listing", "textarea")
        return Setting(visible, as_is, self.lists + (tag in LISTS), self.tables + (tag == "table"), drawn)


def shown(element: Element) -> bool:
    a, tag = element.attributes, element.tag
    unseen = tag in UNSEEN or "hidden" in a or (tag == "dialog" and "open" not in a) or (tag == "object" and bool(a.get("data")))
    return not (unseen or ("style" in a and HIDING.search(a["style"])))


def fill(flow: Flow, parent: Element, here: Setting) -> Call:
    """Writes a parent's children into the flow."""
    item = parent.number("start", 1)
    closed = parent.tag == "details" and "open" not in parent.attributes
    for child in parent.children:
        if isinstance(child, str):
            if here.visible and not closed and not here.drawn:
                flow.put_as_is(child) if here.as_is else flow.put(child)
            continue
        tag = child.tag
        if tag == "br" and not closed and shown(child):
            flow.end_line(True)
        if tag in VOID and tag != "hr" or not shown(child) or (closed and tag != "summary"):
            continue
        inner = here.within(child)
        if tag == "li":
            mark = "- "
            if parent.tag == "ol":
                item = child.number("value", item)
                mark, item = f"{item}. ", item + 1
            flow.block(0)
            flow.enter(mark)
            yield fill(flow, child, inner)
            flow.leave()
            flow.block(0)
            continue
        margin = int(not here.lists if tag in LISTS else tag in SPACED)
        block = margin or tag in PLAIN
        if block:
            flow.block(margin)
        if tag == "table" and inner.tables <= MAX_TABLES:
            for line in (yield table(child, inner)):
                flow.add(line)
        elif tag in ("blockquote", "dd"):
            flow.enter("  ")
            yield fill(flow, child, inner)
            flow.leave()
        else:
            yield fill(flow, child, inner)
        if block:
            flow.block(margin)


def inside(element: Element, here: Setting) -> Call:
    """The lines of an element's content."""
    flow = Flow()
    yield fill(flow, element, here)
    return flow.done()


def table(element: Element, here: Setting) -> Call:
    """A table's rows, their cells aligned; the caption and stray content come first."""
    rows, other = [], Element("div")
    for child in element.children:
        section = isinstance(child, Element) and child.tag in ("tbody", "thead", "tfoot")
        if section and not shown(child):
            continue
        around = here.within(child) if section else here
        for x in child.children if section else [child]:
            if not isinstance(x, Element) or x.tag != "tr":
                other.children.append(x)
            elif shown(x):
                rows.append((x, around.within(x)))
    grid: list[dict[int, list[str]]] = []
    tall_cells: list[list[int]] = []  # first column, last + 1, rows still to skip; by column
    for row, around in rows:
        cells, at, stray, skip, below = {}, 0, Element("div"), 0, []
        for cell in row.children:
            if not isinstance(cell, Element) or cell.tag not in ("td", "th"):
                stray.children.append(cell)
                continue
            while skip < len(tall_cells) and tall_cells[skip][0] <= at:
                at = max(at, tall_cells[skip][1])
                skip += 1
            wide, tall = max(1, cell.number("colspan", 1, 1000)), max(1, cell.number("rowspan", 1, 1000))
            cells[at] = (yield inside(cell, around.within(cell))) if shown(cell) else []
            if tall > 1:
                below.append([at, at + wide, tall - 1])
            at += wide
        tall_cells = sorted([[a, b, n - 1] for a, b, n in tall_cells if n > 1] + below)
        if extra := (yield inside(stray, around)):
            grid.append({0: extra})
        grid.append(cells)
    used = sorted({c for cells in grid for c, lines in cells.items() if lines})
    width = dict.fromkeys(used, 0)
    for cells in grid:
        for c, lines in cells.items():
            if lines:
                width[c] = max(width[c], min(MAX_COLUMN, max(map(len, lines))))
    out = yield inside(other, here)
    for cells in grid:
        last = max((c for c, lines in cells.items() if lines), default=-1)
        columns = used[: bisect_right(used, last)]
        for i in range(max(map(len, cells.values()), default=0)):
            line = "  ".join((cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(width[c]) for c in columns)
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    """The text that a page shows, with its line layout."""
    lines = finish(inside(parse(page), Setting())) if page else []
    return "\n".join(lines).replace("\xa0", " ")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_lines, n_bytes of every page."""

    def each(rows: dict[str, list]) -> dict[str, list]:
        texts = [visible_text(x) for x in rows[html_col]]
        return {id_col: rows[id_col], "text": [utf8(x).decode("utf-8", "replace") for x in texts], "n_lines": [x.count("\n") + 1 if x else 0 for x in texts], "n_bytes": [len(utf8(x)) for x in texts]}

    return map_rows(pages.select(id_col, html_col), each, f"`{id_col}` long, text string, n_lines long, n_bytes long", rows=500)
