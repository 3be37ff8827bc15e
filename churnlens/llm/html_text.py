"""HTML to text by layout: what a reader sees, with block spacing, lists and aligned table cells.

A tree builder closes elements whose end tags are implied; the renderer leaves
out what visibility rules hide, collapses white space as a browser does, puts
blocks on lines of their own with margins between them, marks list items, and
pads table cells to columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.tables import small_batches, unused

#: Kinds of input whose value is on the page.
SHOWN_INPUTS = set("text search url email tel number date month week time datetime-local submit button reset".split())

#: Elements nested more deeply become children of the one at this depth; no text is lost.
MOST_DEPTH = 200

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
HIDDEN = RAW - {"xmp"} | set("head title template noscript object audio video canvas datalist defs desc metadata symbol annotation annotation-xml".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table "
    "caption ul xmp".split()
)
MARGIN = set("p ul ol dl menu dir pre xmp blockquote figure table h1 h2 h3 h4 h5 h6 fieldset".split())
LISTS = set("ul ol menu dir".split())
#: Start tags that end an open paragraph.
ENDS_P = (BLOCK | {"hr"}) - set("body html caption option optgroup legend".split())
#: Start tag: open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: End tags do not reach beyond these.
SCOPE = set("table td th caption template".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    return {
        m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in reversed(list(_ATTR.finditer(raw)))
    }


def parse(source: str) -> Node:
    """Tree of the page; texts are strings among the children."""
    root = Node("html", {})
    stack = [root]
    at = 0

    def close(ends: set[str], limits: set[str]) -> None:
        """Ends the outermost of the open elements `ends` that stands within the limits, and all within it."""
        cut = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in limits:
                break
            if stack[k].tag in ends:
                cut = k
        if cut:
            del stack[cut:]

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue  # inside a raw element
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if name := m["end"]:
            name = name.lower()
            limits = SCOPE - {name} if name in ("td", "th", "caption") else set() if name in ("table", "template") else SCOPE
            if name in ("tr", "thead", "tbody", "tfoot"):
                limits = {"table"}
            close_one(stack, name, limits)
        elif name := m["start"]:
            name = name.lower()
            attrs = attributes(m["attrs"]) if m["attrs"].strip(" /\t\n") else {}
            if name == "html":
                root.attrs = attrs | root.attrs
                continue
            if name in ENDS_P:
                close({"p"}, SCOPE)
            if name in IMPLIED:
                close(*IMPLIED[name])
            node = Node(name, attrs)
            stack[-1].children.append(node)
            if name in RAW or name in ("title", "textarea"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                inner = source[at : end.start() if end else len(source)]
                node.children.append(inner if name in RAW else html.unescape(inner))
                at = end.end() if end else len(source)
            elif name not in VOID and len(stack) < MOST_DEPTH:
                stack.append(node)
    if at < len(source):
        stack[-1].children.append(html.unescape(source[at:]))
    return root


def close_one(stack: list[Node], name: str, limits: set[str]) -> None:
    """Ends the innermost open element of this name, and all within it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == name:
            del stack[k:]
            return
        if stack[k].tag in limits:
            return


def shown(node: Node) -> bool:
    """Whether visibility rules let the element appear."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a:
        return False
    if node.tag == "input" and a.get("type", "text").strip().lower() not in SHOWN_INPUTS:
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _NOT_SHOWN.search(a["style"]))


class Canvas:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.words, self.space = [], False
        self.gap = 0  # blank lines owed before the next line
        self.indent, self.mark = "", ""

    def text(self, value: str, pre: bool) -> None:
        if pre:
            first, *rest = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.words.append(first)
            for line in rest:
                self.end_line(keep=True)
                self.words.append(line)
            return
        value = _SPACES.sub(" ", value)
        if value[:1] == " " and self.words:
            self.space = True
        value = value.strip(" ") if value.strip(" ") else ""
        if value:
            if self.space and self.words:
                self.words.append(" ")
            self.words.append(value)
            self.space = False

    def trailing(self, value: str) -> None:
        if self.words and value[-1:] in " \t\n\r\f":
            self.space = True

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.words)
        self.words, self.space = [], False
        if line or keep:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + line).rstrip() if line else "")
            self.mark = ""

    def block(self, margin: int) -> None:
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, margin)


def render(node: Node, canvas: Canvas, pre: bool = False) -> None:
    """Draws the children of a node."""
    number = _start(node) if node.tag == "ol" else 0
    for child in node.children:
        if isinstance(child, str):
            canvas.text(child, pre)
            if not pre:
                canvas.trailing(child)
            continue
        tag = child.tag
        if not shown(child):
            continue
        if tag == "br":
            canvas.end_line(keep=True)
        elif tag == "input":
            canvas.text(child.attrs.get("value", ""), False)
        elif tag == "textarea":
            for k, line in enumerate("".join(c for c in child.children if isinstance(c, str)).strip("\r\n").splitlines()):
                if k:
                    canvas.end_line(keep=True)
                canvas.text(line, False)
        elif tag == "select" and not _listed(child):
            for option in _chosen(child):
                canvas.text(option.attrs.get("label", ""), False) if "label" in option.attrs else render(option, canvas)
        elif tag == "hr":
            canvas.block(0)
            canvas.words.append("-" * 8)
            canvas.block(0)
        elif tag == "table":
            canvas.block(1)
            for line in table_lines(child):
                canvas.words.append(line)
                canvas.end_line(keep=True)
            canvas.block(1)
        elif tag in BLOCK:
            nested_list = tag in LISTS and canvas.indent != ""
            margin = int(tag in MARGIN and not nested_list)
            canvas.block(margin)
            before = canvas.indent
            if tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "* "
                number += 1
                canvas.indent, canvas.mark = before + " " * len(mark), mark
            elif tag in ("dd", "blockquote"):
                canvas.indent = before + "  "
            render(child, canvas, pre or tag in ("pre", "xmp"))
            canvas.end_line()
            if canvas.mark and tag == "li":  # an empty item
                canvas.mark = ""
            canvas.indent = before
            canvas.block(margin)
        else:
            render(child, canvas, pre)


def _listed(select: Node) -> bool:
    """Whether a select shows all its options, as a list of several lines."""
    size = select.attrs.get("size", "1").strip()
    return "multiple" in select.attrs or (size.isdecimal() and len(size) < 6 and int(size) > 1)


def _chosen(select: Node) -> list[Node]:
    """The option that a closed select shows: the last selected one, else the first that can be chosen."""
    options, nodes = [], [*select.children][::-1]
    while nodes:
        node = nodes.pop()
        if isinstance(node, Node):
            if node.tag == "option":
                options.append(node)
            else:
                nodes += node.children[::-1]
    marked = [o for o in options if "selected" in o.attrs]
    return marked[-1:] or [o for o in options if "disabled" not in o.attrs][:1]


def _start(node: Node) -> int:
    value = node.attrs.get("start", "1").strip()
    return int(value) if re.fullmatch(r"-?\d{1,9}", value) else 1


def _rows(node: Node, captions: list[Node], rows: list[Node]) -> None:
    for child in node.children:
        if isinstance(child, str) or not shown(child):
            if isinstance(child, str) and child.strip():
                loose = Node("caption", {})
                loose.children.append(child)
                captions.append(loose)
            continue
        if child.tag == "tr":
            rows.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            _rows(child, captions, rows)
        elif child.tag in ("td", "th"):
            if not rows or rows[-1].attrs.get("of") != "cells":
                rows.append(Node("tr", {"of": "cells"}))
            rows[-1].children.append(child)
        elif child.tag not in VOID:
            captions.append(child)


def drawn(node: Node) -> list[str]:
    canvas = Canvas()
    render(node, canvas, node.tag in ("pre", "xmp"))
    canvas.end_line()
    return canvas.lines


def table_lines(table: Node) -> list[str]:
    """Captions, then the rows with cells padded to the width of their column; a cell may have several lines."""
    captions, rows = [], []
    _rows(table, captions, rows)
    lines = [line for c in captions for line in drawn(c)]
    grid = []
    for row in rows:
        cells = []
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    cells.append(_SPACES.sub(" ", cell).strip().split("\n"))
                continue
            if not shown(cell):
                continue
            cells.append(drawn(cell))
            span = cell.attrs.get("colspan", "1").strip()
            cells += [[]] * (min(1000, int(span)) - 1 if span.isdecimal() and len(span) < 5 else 0)
        grid.append(cells)
    width = [0] * max([0, *map(len, grid)])
    for cells in grid:
        for k, cell in enumerate(cells):
            width[k] = max(width[k], *[len(line) for line in cell], 0)
    for cells in grid:
        for depth in range(max([0, *map(len, cells)])):
            parts = [(cell[depth] if depth < len(cell) else "").ljust(width[k]) for k, cell in enumerate(cells)]
            lines.append("  ".join(parts).rstrip())
    return lines


def visible_text(source: str | None) -> str:
    """The text a reader sees; empty for a null or empty page."""
    if not source:
        return ""
    lines = drawn(parse(source))
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        for lo in range(0, len(batch), 128):
            part = batch.slice(lo, 128)
            texts = pa.array([visible_text(x) for x in part.column(last).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in range(last)], texts], [*batch.schema.names[:last], "visible_text"]
            )


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with `visible_text`; a column of that name is replaced. Null and empty pages have an empty text.

    Malformed markup is read as a browser would as far as its text goes:
    unknown and stray tags are dropped, an unclosed element ends with its
    parent. Every row gives one row, repeated rows too; a very long page is read as a
    whole, and an empty table gives an empty result.
    """
    names = [c for c in pages.columns if c != "visible_text"]
    small_batches(pages.sparkSession)
    rows = pages.select(*names, F.col(html_col).cast("string").alias(unused(pages, "source")))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_text_rows, ", ".join([*fields, "visible_text string"]))
