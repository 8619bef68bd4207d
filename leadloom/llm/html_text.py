"""Visible text of HTML pages by a small layout: tree building, visibility, blocks.

The tree builder opens and closes elements with HTML's implied tags (a paragraph ends
before a block, a list item before the next, the head before content, a cell opens its
row); content between a table's parts goes before the table.  Rendering walks the tree:
elements that are hidden by their kind, attribute, inline style or a simple rule of a
style sheet give nothing, blocks stand on lines of their own with blank lines where they
have margins, list items get bullets or numbers by depth, and table cells are padded to
the width of the columns that they span, as far as the padding stays in proportion to the text.

Both walks keep stacks of their own and touch an element a bounded number of times, so
time and text are linear in the page however deep it nests, but for tables with many cells
of different row spans, where a row passes the spans that reach down into it.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe datalist noembed noframes audio video canvas param title rp".split())
#: Inside drawings and formulas these are descriptions, definitions or sources, not what is drawn.
NOT_DRAWN = frozenset("desc metadata defs symbol clippath mask pattern annotation annotation-xml".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre textarea listing xmp table figure hr fieldset".split())
BLOCK = MARGIN | frozenset(
    "html body address article aside details dialog dd dir div dt figcaption footer form header hgroup legend li main nav search section summary center caption optgroup option".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("html body caption optgroup option textarea".split())
LISTS = frozenset({"ul", "ol", "menu", "dir"})
CELLS = frozenset({"td", "th", "caption"})
SECTIONS = frozenset({"tbody", "thead", "tfoot"})
PARTS = CELLS | SECTIONS | frozenset({"colgroup", "col", "tr"})
#: Elements that hold table parts only, and what else may stay in them; all other content goes before the table.
CONTEXT = SECTIONS | frozenset({"table", "tr"})
STAYS = PARTS | frozenset({"script", "style", "template"})
#: An end tag of another kind doesn't reach beyond these.
BARRIERS = CELLS | frozenset({"table"})
#: The largest spans of a cell in the HTML standard.
COLUMNS, ROWS = 1000, 65534
#: Deeper list items are marked but not indented further, or blanks would outgrow the text.
INDENTED = 64
#: Tables whose padding would make them so many times as long as their text have their cells' lines broken at blanks to so
#: many letters; if that isn't enough, cells stand side by side without padding.
PADDED, WIDTH = 12, 80

# Possessive, without limits of length: a tag matches at its first try, closed or cut by the page's end (the last group is
# then empty), so no part of a page is read again and again.  A quote counts only where it opens an attribute's value.
_OTHER = r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(_OTHER + r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S)
#: The same after a tag that the page's end cuts: quotes don't count, so that what follows is not lost in one.
_TOKEN_PLAIN = re.compile(_OTHER + r"([^>]*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"([a-z][\w-]*)?([.#][\w-]+)?", re.I)


class Node:
    """An element; the last seven fields are the nearest open element of a kind, itself included."""

    __slots__ = ("tag", "attributes", "children", "paragraph", "item", "term", "cell", "row", "table", "drawing")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.paragraph = self.item = self.term = self.cell = self.row = self.table = self.drawing = None

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def number(self, name: str, default: int, most: int) -> int:
        value = (self.attribute(name) or "").strip() if name in self.attributes.lower() else ""
        digits = value.lstrip("+-")
        return max(-most, min(most, int(value))) if digits.isascii() and digits.isdigit() and len(digits) < 10 else default


def _declared(style: str) -> tuple[str | None, str | None]:
    """The last display and visibility that a style declares."""
    found = {m[1].lower(): m[2].lower() for m in _DECLARED.finditer(style)}
    return found.get("display"), found.get("visibility")


class Builder:
    """Elements that are open, innermost last; one that ends is taken off once."""

    def __init__(self):
        self.root = Node("#document")
        self.open = [self.root]
        self.counts: list[Counter[str]] = [Counter()]  # open elements by tag since each open barrier
        self.title: str | None = None
        self.rules: dict[str, str] = {}

    def build(self, page: str) -> Node:
        at, n = 0, len(page)
        token = _TOKEN
        while at < n:
            m = token.search(page, at) if page.find(">", at) >= 0 or page.find("<!--", at) >= 0 else None
            if not m:
                self.text(page[at:])
                break
            if m.start() > at:
                self.text(page[at : m.start()])
            name = m[2]
            if name and not m[4] and page.find(">", m.start()) >= 0:
                token, at = _TOKEN_PLAIN, m.start()
                continue
            if name and not m[4]:
                self.text(page[m.start() :])
                break
            at = m.end()
            if not name:
                continue
            tag = name.lower()
            if m[1]:
                self.end(tag)
                continue
            node = self.start(tag, m[3] or "")
            if self.is_raw(tag):
                low = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                self.raw(node, page[at : low.start() if low else n])
                at = page.find(">", low.start()) + 1 if low else n
                at = at or n
        return self.root

    def raw(self, node: Node, content: str) -> None:
        node.children.append(content)
        if node.tag == "title" and self.title is None:
            self.title = _SPACES.sub(" ", html.unescape(content)).strip(" ")
        elif node.tag == "style" and (node.attribute("media") or "all").strip().lower() in ("", "all", "screen"):
            self.sheet(content)

    def is_raw(self, tag: str) -> bool:
        return tag in RAW and not (tag in ("title", "style") and self.open[-1].drawing is not None)

    def sheet(self, content: str) -> None:
        """Rules of one tag, class, id or tag with one of them; others, and those inside at-rules, are not applied."""
        content, at = _COMMENT.sub(" ", content.replace("<!--", " ").replace("-->", " ")), 0
        while (brace := content.find("{", at)) >= 0:
            selectors = content[at:brace].rsplit(";", 1)[-1].strip()
            end = content.find("}", brace)
            end = len(content) if end < 0 else end
            if selectors.startswith("@"):
                depth, end = 1, brace + 1
                for m in re.compile(r"[{}]").finditer(content, end):
                    depth += 1 if m[0] == "{" else -1
                    end = m.end()
                    if not depth:
                        break
                at = end if not depth else len(content)
                continue
            display, visibility = _declared(content[brace + 1 : end])
            for selector in selectors.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if m and m[0] and (display or visibility):
                    self.rules[(m[1] or "").lower() + (m[2] or "")] = "none" if display == "none" else visibility or ""
            at = end + 1

    def push(self, node: Node) -> None:
        here, tag = self.open[-1], node.tag
        table = tag == "table"
        node.table = node if table else here.table
        node.cell = node if tag in CELLS else None if table else here.cell
        node.row = node if tag == "tr" else None if table else here.row
        fresh = table or tag in CELLS
        node.paragraph = node if tag == "p" else None if fresh or tag in ("button", "object") else here.paragraph
        node.item = node if tag == "li" else None if fresh or tag in LISTS else here.item
        node.term = node if tag in ("dt", "dd") else None if fresh or tag == "dl" else here.term
        node.drawing = node if tag in ("svg", "math") else None if tag == "foreignobject" else here.drawing
        self.open.append(node)
        self.counts[-1][tag] += 1
        if tag in BARRIERS:
            self.counts.append(Counter())

    def pop(self) -> Node:
        node = self.open.pop()
        if node.tag in BARRIERS:
            self.counts.pop()
        self.counts[-1][node.tag] -= 1
        return node

    def pop_through(self, node: Node) -> None:
        while self.pop() is not node:
            pass

    def pop_to(self, node: Node) -> None:
        while self.open[-1] is not node:
            self.pop()

    def add(self, item: Node | str, stays: bool) -> None:
        """Put a text or an element where it is shown: between the parts of a table is before the table."""
        here = self.open[-1]
        if not stays and here.tag == "colgroup":
            self.pop()
            here = self.open[-1]
        if not stays and here.tag in CONTEXT and here.table is not None:
            # The table's holder: its last child is the open table.
            here.table.children[0].children.insert(-1, item)
        else:
            here.children.append(item)

    def text(self, data: str) -> None:
        blank = not data.strip()
        if not blank and self.open[-1].tag == "head":
            self.pop()
        self.add(data, blank)

    def start(self, tag: str, attributes: str) -> Node:
        here = self.open[-1]
        if here.tag == "head" and tag not in HEAD:
            self.pop()
            here = self.open[-1]
        if here.drawing is not None and (tag in BLOCK or tag in PARTS):  # no part of a drawing
            self.pop_through(here.drawing)
            here = self.open[-1]
        if tag in ENDS_PARAGRAPH and here.paragraph is not None:
            self.pop_through(here.paragraph)
        here = self.open[-1]
        if tag == "li" and here.item is not None:
            self.pop_through(here.item)
        elif tag in ("dt", "dd") and here.term is not None:
            self.pop_through(here.term)
        elif tag in ("option", "optgroup") and here.tag in ("option", "optgroup"):
            if here.tag == "option":
                self.pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self.pop()
        elif tag in PARTS or tag == "table":
            self.part(tag)
        node = Node(tag, attributes)
        here = self.open[-1]
        if tag == "form" and here.tag in CONTEXT and here.table is not None:  # such a form holds nothing
            here.children.append(node)
            return node
        self.add(node, tag in STAYS)
        if tag == "table":
            node.children.append(Node("#holder"))
            node.children[0].children = self.open[-1].children
        # A slash before the bracket ends only what is drawn.
        drawn = tag in ("svg", "math") or here.drawing is not None
        if tag not in VOID and not self.is_raw(tag) and not (drawn and attributes.endswith("/")):
            self.push(node)
        return node

    def part(self, tag: str) -> None:
        """Close what a table part, or a table between parts, ends; a cell without a row gets one."""
        here = self.open[-1]
        table = here.table
        if table is None:
            return
        if tag == "table":
            if here.cell is None:
                self.pop_through(table)
            return
        if tag in ("td", "th"):
            if here.row is not None:
                self.pop_to(here.row)
                return
            self.section_level(here)
            row = Node("tr")
            self.open[-1].children.append(row)
            self.push(row)
        elif tag == "tr":
            if here.row is not None:
                self.pop_through(here.row)
            else:
                self.section_level(here)
        elif tag == "col" and here.tag == "colgroup":
            return
        else:
            self.pop_to(table)

    def section_level(self, here: Node) -> None:
        """Back to the open section, or to the table."""
        if here.cell is not None:  # a caption
            self.pop_through(here.cell)
        while self.open[-1].tag not in SECTIONS and self.open[-1] is not here.table:
            self.pop()

    def end(self, tag: str) -> None:
        here = self.open[-1]
        if tag in ("body", "html"):
            return
        if tag == "br":
            self.add(Node("br"), False)
        elif tag == "p" and here.paragraph is None:
            self.add(Node("p"), False)
        elif tag in CELLS or tag == "tr" or tag in SECTIONS or tag == "table":
            self.end_part(here, tag)
        elif self.counts[-1][tag]:
            while self.pop().tag != tag:
                pass

    def end_part(self, here: Node, tag: str) -> None:
        table = here.table
        if tag == "table" and table is not None:
            self.pop_through(table)
        elif tag in CELLS:
            if here.cell is not None and here.cell.tag == tag:
                self.pop_through(here.cell)
        elif tag == "tr":
            if here.row is not None:
                self.pop_through(here.row)
        elif table is not None and tag in SECTIONS and (here.cell is None or here.row is not None):
            while self.open[-1] is not table and self.open[-1].tag != tag:
                self.pop()
            if self.open[-1] is not table:
                self.pop()


class _Lines:
    """Lines of text with collapsed white space and blank lines between blocks.

    ``indent`` stands before every line; ``mark`` (of a list item that has no line yet)
    stands in its place before the next one, and margins wait until then.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.last, self.blank, self.pre = " ", False, 0
        self.indent, self.mark = "", None
        self.depth = 0
        self.lists: list[_List] = []
        self.loose = _List(False, 1)

    def text(self, data: str) -> None:
        if self.pre:
            first, *rest = data.split("\n")
            self.parts.append(first)
            for line in rest:
                self.flush()
                self.parts.append(line)
            return
        data = _SPACES.sub(" ", data)
        if self.last == " ":
            data = data.lstrip(" ")
        if data:
            self.parts.append(data)
            self.last = data[-1]

    def flush(self) -> None:
        """End a line of preformatted text; blank ones stay."""
        line = "".join(self.parts).rstrip(" \t\r")
        self.parts.clear()
        if line or self.lines:
            self.put(line)
        self.last = " "

    def put(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.blank = False
        before = self.indent if self.mark is None else self.mark
        self.mark = None
        self.lines.append((before + line).rstrip(" "))

    def end(self, margin: bool = False) -> None:
        if self.parts:
            line = "".join(self.parts).rstrip(" ") if self.pre else "".join(self.parts).strip(" ")
            self.parts.clear()
            if line:
                self.put(line)
        self.last = " "
        self.blank = self.blank or margin and self.mark is None

    def whole(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end()
        if len(lines) and not self.lines and not self.indent and self.mark is None:
            self.lines, self.blank = lines, False
        else:
            for line in lines:
                self.put(line)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    """The rows of a table while its cells are laid out: first the head's, last the foot's."""

    def __init__(self):
        self.captions: list[str] = []
        self.rows: dict[str, list[list[tuple[int, int, list[str]]]]] = {"thead": [], "tbody": [], "tfoot": []}
        self.sections: list[str] = []
        self.seen: set[str] = set()

    def section(self, tag: str) -> None:
        """Only the first head and foot of a table have places of their own."""
        self.sections.append("tbody" if tag in self.seen else tag)
        self.seen.add(tag)

    def row(self) -> None:
        self.rows[self.sections[-1] if self.sections else "tbody"].append([])

    def cell(self, node: Node, lines: list[str]) -> None:
        own = self.rows[self.sections[-1] if self.sections else "tbody"]
        if not own:
            own.append([])
        own[-1].append((max(1, node.number("colspan", 1, COLUMNS)), max(0, node.number("rowspan", 1, ROWS)), lines))

    def lines(self) -> list[str]:
        groups = list(self.rows.values())
        if sum(map(len, groups)) == 1 and sum(len(r) for g in groups for r in g) == 1:
            only = next(r for g in groups for r in g)[0][2]
            return self.captions + only if self.captions else only
        placed = [own for group in groups for own in _columns(group)]
        # Columns that no cell begins or ends in are one.
        edges = sorted({e for row in placed for a, b, _ in row for e in (a, b)})
        index = {e: i for i, e in enumerate(edges)}
        cells = [[(index[a], index[b], x) for a, b, x in row] for row in placed]
        room = PADDED * (sum(len(line) + 1 for row in cells for _, _, x in row for line in x) + sum(map(len, cells)) + len(cells))
        for most in (None, WIDTH):
            if most:
                cells = [[(a, b, [part for line in x for part in _broken(line, most)]) for a, b, x in row] for row in cells]
            starts = _starts(cells, len(edges) - 1, most)
            if sum((starts[row[-1][1]] + 1) * max(len(x) for _, _, x in row) for row in cells if row) <= room:
                return self.captions + [line for row in cells for line in _aligned(row, starts)]
        return self.captions + [line for row in cells for line in _in_turn(row)]


def _columns(group: list[list[tuple[int, int, list[str]]]]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """Of each row of a head, body or foot its cells as (first column, last column + 1, lines).

    Cells that reach down from rows above are kept as intervals of columns, by column,
    each with the first row that is free there; neighbours that end alike are one.
    """
    down: list[tuple[int, int, int]] = []
    for r, row in enumerate(group):
        at, own, kept, k = 0, [], [], 0

        def reaches(a: int, b: int, until: int) -> None:
            if kept and kept[-1][1] == a and kept[-1][2] == until:
                kept[-1] = (kept[-1][0], b, until)
            else:
                kept.append((a, b, until))

        for wide, tall, lines in row:
            # A cell takes the first free column, and all its columns even where one reaches down into them.
            while k < len(down) and (down[k][1] <= at or down[k][0] <= at or down[k][2] <= r):
                a, b, until = down[k]
                if until > r:
                    at = max(at, b)
                    reaches(a, b, until)
                k += 1
            own.append((at, at + wide, lines))
            until = len(group) if tall == 0 else min(len(group), r + tall)
            if until > r + 1:
                reaches(at, at + wide, until)
            at += wide
        for a, b, until in down[k:]:
            if until > r + 1:
                reaches(a, b, until)
        down = [x for x in kept if x[2] > r + 1]
        yield own


def _broken(line: str, most: int) -> list[str]:
    """A line cut at blanks into lines of at most ``most`` letters; a longer word has one of its own."""
    parts: list[str] = []
    at, n = 0, len(line)
    while n - at > most:
        cut = line.rfind(" ", at + 1, at + most + 1)
        if cut < 0:
            cut = line.find(" ", at + most)
        if cut < 0:
            break
        parts.append(line[at:cut].rstrip(" "))
        at = cut + 1
    return [*parts, line[at:]]


def _starts(cells: list[list[tuple[int, int, list[str]]]], columns: int, most: int | None) -> list[int]:
    """Where each column begins, the separators before it included; words longer than ``most`` may stick out."""
    widths = [0] * max(0, columns)
    longest = lambda x: min(most or sys.maxsize, max(map(len, x), default=0))
    for row in cells:
        for a, b, x in row:
            if b == a + 1:
                widths[a] = max(widths[a], longest(x))
    for row in cells:
        for a, b, x in row:
            if b > a + 1:
                widths[b - 1] += max(0, longest(x) - sum(widths[a:b]) - 3 * (b - a - 1))
    return [0, *accumulate(w + 3 for w in widths)]


def _aligned(row: list[tuple[int, int, list[str]]], starts: list[int]) -> Iterator[str]:
    """The lines of a row, each cell from its column's beginning on."""
    gaps = {b: "".join(" " * (starts[c + 1] - starts[c] - 3) + " | " for c in range(b, a)) for b, a in zip([0, *[b for _, b, _ in row]], [a for a, _, _ in row]) if a > b}
    for k in range(max((len(x) for _, _, x in row), default=0)):
        parts, at = [], 0
        for a, b, x in row:
            parts.append(gaps.get(at, "") if a > at else "")
            parts.append((x[k] if k < len(x) else "").ljust(starts[b] - starts[a] - 3) + " | ")
            at = b
        yield "".join(parts)[:-3].rstrip(" ")


def _in_turn(row: list[tuple[int, int, list[str]]]) -> Iterator[str]:
    """The lines of a row whose table is too wide for its text: cells stand side by side, without padding."""
    left = [x for _, _, x in row if x]
    k = 0
    while left:
        yield " | ".join(x[k] for x in left).rstrip(" ")
        k += 1
        left = [x for x in left if len(x) > k]


def _shown(node: Node, rules: dict[str, str]) -> str | None:
    """none (it takes no place), hidden or visible (it and what inherits from it), or None (as its parent)."""
    tag = node.tag
    if tag in HIDDEN:
        return "none"
    if not node.attributes and not rules:
        return "none" if tag == "dialog" else None
    low = node.attributes.lower()
    if tag == "dialog" and node.attribute("open") is None or "hidden" in low and node.attribute("hidden") is not None:
        return "none"
    if tag == "input" and (node.attribute("type") or "").lower() == "hidden":
        return "none"
    display, visibility = _declared(node.attribute("style") or "") if "style" in low else (None, None)
    if rules and display is None:
        keys = [tag]
        for name in (node.attribute("class") or "").split() if "class" in low else ():
            keys += ["." + name, f"{tag}.{name}"]
        own = node.attribute("id") if "id" in low else None
        if own:
            keys += ["#" + own, f"{tag}#{own}"]
        for key in keys:
            value = rules.get(key)
            if value == "none":
                display = "none"
            elif value and visibility is None:
                visibility = value
    if display == "none":
        return "none"
    return {"hidden": "hidden", "collapse": "hidden", "visible": "visible"}.get(visibility or "")


_TYPED = frozenset({"", "text", "search", "email", "url", "tel", "number", "date", "submit", "button", "reset"})


def render(root: Node, rules: dict[str, str] | None = None) -> list[str]:
    """The lines of a tree."""
    rules = rules or {}
    out = _Lines()
    outs: list[_Lines] = []
    tables: list[_Table] = []
    inside: list[str] = []  # open drawings and formulas
    hidden = [False]
    stack: list[tuple[str, Node | str]] = [("open", child) for child in reversed(root.children)]
    while stack:
        step, item = stack.pop()
        if isinstance(item, str):
            if not hidden[-1]:
                out.text(html.unescape(item))
            continue
        tag = item.tag
        if step == "close":
            hidden.pop()
            if tag in ("td", "th", "caption") and outs:
                lines, out = out.done(), outs.pop()
                if tag == "caption":
                    tables[-1].captions += lines
                else:
                    tables[-1].cell(item, lines)
            elif tag == "table":
                lines = tables.pop().lines()
                out.end(True)
                out.whole(lines)
                out.end(True)
            elif tag in SECTIONS and tables:
                tables[-1].sections.pop()
            elif tag == "li":
                out.end()
                indent, mark, depth = out.lists[-1].pop() if out.lists else out.loose.pop()
                out.indent, out.depth = indent, depth
                if out.mark is None:
                    out.blank = False
                else:
                    out.mark = mark
            elif tag in LISTS:
                out.end(len(out.lists) == 1)
                out.lists.pop()
            elif tag in ("pre", "listing", "xmp", "textarea"):
                out.end(True)
                out.pre -= 1
            elif tag in ("svg", "math"):
                inside.pop()
            elif tag in BLOCK:
                out.end(tag in MARGIN)
            elif tag == "text":
                out.text(" ")
            continue
        if tag == "#holder" or inside and tag in NOT_DRAWN:
            continue
        shown = _shown(item, rules)
        if shown == "none":
            continue
        quiet = shown == "hidden" or hidden[-1] and shown != "visible"
        children = item.children
        if tag == "br":
            if out.pre:
                out.flush()
            elif out.parts:
                out.end()
            else:
                out.blank = out.blank or out.mark is None
            continue
        if tag == "hr":
            out.end(True)
            if not quiet:
                out.put("-" * 10)
            out.end(True)
            continue
        if tag in ("img", "area"):
            if tag == "img" and not quiet:
                out.text(item.attribute("alt") or "")
            continue
        if tag == "input":
            if not quiet and (item.attribute("type") or "").lower() in _TYPED:
                out.text(item.attribute("value") or "")
            continue
        if tag == "object" and item.attribute("data") is not None:
            continue
        hidden.append(quiet)
        stack.append(("close", item))
        if tag == "table":
            tables.append(_Table())
            out.end(True)
            children = [c for c in children if isinstance(c, Node) and c.tag in STAYS]
        elif tag in ("td", "th", "caption") and tables:
            outs.append(out)
            out = _Lines()
        elif tag in ("td", "th", "caption"):  # a part without a table is a block
            out.end()
            stack[-1] = ("close", Node("div"))
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in SECTIONS and tables:
            tables[-1].section(tag)
        elif tag in LISTS:
            out.end(not out.lists)
            out.lists.append(_List(tag == "ol", item.number("start", 1, 10**9) if tag == "ol" else 1))
        elif tag == "li":
            out.end()
            holder = out.lists[-1] if out.lists else out.loose
            mark = holder.mark(item)
            holder.append((out.indent, out.mark, out.depth))
            before = out.indent if out.mark is None else out.mark
            if out.depth < INDENTED:
                out.mark, out.indent = before + mark, out.indent + " " * len(mark)
            else:
                out.mark = out.indent + mark
            out.depth += 1
        elif tag in ("pre", "listing", "xmp", "textarea"):
            out.end(True)
            out.pre += 1
            if children and isinstance(children[0], str) and children[0].startswith(("\n", "\r\n")):
                children = [children[0].split("\n", 1)[1], *children[1:]]
        elif tag in ("svg", "math"):
            inside.append(tag)
        elif tag in BLOCK:
            out.end(tag in MARGIN)
            if tag == "optgroup" and not quiet:
                out.text(item.attribute("label") or "")
        elif tag == "text" and inside:
            out.text(" ")
        stack += [("open", child) for child in reversed(children)]
    return out.done()


class _List(list):
    """An open list: the states before its open items."""

    def __init__(self, ordered: bool, number: int):
        super().__init__()
        self.ordered, self.number = ordered, number

    def mark(self, item: Node) -> str:
        if not self.ordered:
            return "- "
        number = item.number("value", self.number, 10**9)
        self.number = number + 1
        return f"{number}. "


def extract(page: str | None) -> tuple[str, str]:
    """Title and visible text of a page; both empty for a null or empty one."""
    if not page:
        return "", ""
    builder = Builder()
    lines = render(builder.build(page), builder.rules)
    return builder.title or "", "\n".join(lines).strip("\n")


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, with ``title``, ``text`` and ``text_chars``.

    Null and empty markup gives an empty title and text; markup without tags is its own
    text.  Columns that have these three names are replaced; rows may repeat.
    """
    others = [c for c in pages.columns if c not in (html_col, "title", "text", "text_chars")]
    source = pages.select(*others, html_col)
    schema = StructType([*pages.select(*others).schema.fields, StructField("title", StringType()), StructField("text", StringType()), StructField("text_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [extract(x) for x in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(others)],
                        pa.array([t for t, _ in found], pa.string()),
                        pa.array([x for _, x in found], pa.string()),
                        pa.array([len(x) for _, x in found], pa.int64()),
                    ],
                    names=[f.name for f in schema],
                )

    return source.mapInArrow(run, schema)
