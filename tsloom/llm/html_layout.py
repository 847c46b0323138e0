"""HTML extraction by layout-aware rendering.

A tokenizer cuts the page into tags and text; a tree builder adds what HTML
implies (paragraphs and list items that a following block ends, table rows and
sections, void elements, unmatched end tags); visibility rules drop what a
browser doesn't show (head matter, scripts, templates, hidden attributes, the
body of closed details, and by inline style what is not displayed, or not
visible unless something inside is again); the renderer writes all visible text
with block spacing, list markers and numbers, preformatted text as it stands,
and tables whose cells are padded to columns by the width they are shown with.
Spans of rows and columns keep the columns in place.

The tree is walked with stacks of its own, so deep nesting is no matter.  A page
is worked on whole, by itself: memory goes with the largest page.

Defined results: null and empty pages give empty text; broken markup is read as
far as it goes, to its end; an unclosed comment, tag or script runs to the end
of the page; null ids and repeated rows stay as they are; an empty table gives
no rows; a clashing column of the result's name is replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?:[!?]|/[^A-Za-z])[^>]*(?:>|\Z)"
    r"|(?P<odd><[/]?[A-Za-z][^>]*>?)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist area param source track meta link base dialog desc metadata defs symbol annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul tr caption optgroup option search".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
CLOSE_P = BLOCKS - {"body", "html", "tr", "caption", "optgroup", "option", "legend"}
#: A start tag of the key ends open elements of the set, up to the nearest of the other set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "caption": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "a": ({"a"}, {"table", "td", "li"}), "button": ({"button"}, {"form"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th caption button html".split())


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def parse(page: str) -> Node:
    """The page's tree."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)

    def close(names: set[str] | frozenset[str], limit: set[str] | frozenset[str]) -> None:
        """Closes everything from the outermost open element of `names` that `limit` doesn't guard."""
        cut = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in limit:
                break
            if stack[k].name in names:
                cut = k
        if cut:
            del stack[cut:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            if m["odd"] and (n := re.match(r"</?([A-Za-z][^\s/>]*)", m["odd"])):
                name, end, attrs = n[1].lower(), m["odd"][1] == "/", {}
            else:
                continue
        else:
            name, end, attrs = name.lower(), bool(m["end"]), _attributes(m["attrs"]) if m["attrs"] and not m["attrs"].isspace() else {}
        if end:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not any(n.name == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            else:
                wanted = HEADINGS if name in HEADINGS else {name}
                limit = {"html"} if name in ("table", "body") else SCOPES - wanted if name not in ("tr", "tbody", "thead", "tfoot") else {"table", "html"}
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in wanted:
                        del stack[k:]
                        break
                    if stack[k].name in limit:
                        break
            continue
        if name == "html":
            root.attrs = attrs | root.attrs
            continue
        if name in CLOSE_P:
            close({"p"}, SCOPES)
        if name in HEADINGS and stack[-1].name in HEADINGS:
            stack.pop()
        if name in ENDS:
            close(*ENDS[name])
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at) if name != "plaintext" else None
            to = stop.start() if stop else size
            text = page[at:to]
            node.children.append(html.unescape(text) if name in ("textarea", "title") else text)
            at = to if stop else size
            if stop:
                gt = page.find(">", at)
                at = gt + 1 if gt >= 0 else size
            continue
        stack.append(node)
    return root


def _style(node: Node) -> dict[str, str]:
    """Inline declarations; of repeated ones the last."""
    pairs = (d.partition(":") for d in node.attrs.get("style", "").split(";"))
    return {name.strip().lower(): value.replace("!important", "").strip().lower() for name, _, value in pairs}


def hidden(node: Node) -> bool:
    """Whether a browser leaves out the element and all that it holds."""
    if node.name in UNSEEN and not (node.name == "dialog" and "open" in node.attrs):
        return True
    a = node.attrs
    return bool(a) and ("hidden" in a or (node.name == "input" and a.get("type", "").lower() == "hidden") or _style(node).get("display") == "none")


def visible(node: Node, inherited: bool) -> bool:
    said = _style(node).get("visibility") if "style" in node.attrs else None
    return said not in ("hidden", "collapse") if said in ("hidden", "collapse", "visible") else inherited


class _Page:
    """Lines written so far, collapsing blanks and empty lines as a browser does."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = self.gap = False
        self.lead = ""
        self.indent: list[str] = []

    def text(self, s: str) -> None:
        s = _BLANKS.sub(" ", s)
        if s.strip(" "):
            if self.now and (self.blank or s[0] == " "):
                self.now.append(" ")
            self.now.append(s.strip(" "))
            self.blank = s[-1] == " "
        elif s:
            self.blank = True

    def exact(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, part in enumerate(parts):
            if k:
                self.end(True)
            if part:
                self.now.append(part)
                self.blank = False

    def end(self, even_empty: bool = False) -> None:
        """Ends the line."""
        line = "".join(self.now)
        self.now, self.blank = [], False
        if not line and not even_empty and not self.lead.strip():
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(("".join(self.indent[: -1 if self.lead else None]) + self.lead if self.indent else self.lead) + line)
        self.lead = ""

    def space(self) -> None:
        self.end()
        self.gap = True

    def done(self) -> str:
        self.end()
        lines = [x.rstrip(" \t") for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return "\n".join(lines)


def _number(value: str, default: int) -> int:
    """An integer as HTML reads it: blanks and a sign in front, anything behind."""
    found = re.match(r"[ \t\n\f\r]*([+-]?[0-9]+)", value)
    return int(found[1]) if found else default


def _spans(cell: Node, rows_left: int) -> tuple[int, int]:
    """Columns and rows that a cell takes, within the bounds that HTML sets: 1 to 1000 columns; 0 rows are all that are left of the section."""
    columns, rows = _number(cell.attrs.get("colspan", ""), 1), _number(cell.attrs.get("rowspan", ""), 1)
    rows = rows if rows >= 0 else 1
    return min(columns, 1000) if columns > 0 else 1, min(rows or rows_left, rows_left)


def _table(node: Node) -> tuple[list[Node], list[list[tuple[Node, int, int]]]]:
    """Captions, and rows of cells (cell, columns, rows), header rows first and footer rows last."""
    captions, parts = [], {"thead": [], "tbody": [], "tfoot": []}
    loose: list[Node] = []

    def add(part: str, rows: list[Node]) -> None:
        for k, row in enumerate(rows):
            parts[part].append([(c, *_spans(c, len(rows) - k)) for c in row.children if isinstance(c, Node) and c.name in ("td", "th") and not hidden(c)])

    for child in node.children:
        if not isinstance(child, Node) or hidden(child):
            continue
        if child.name == "tr":
            loose.append(child)
            continue
        if child.name in parts:
            add("tbody", loose)
            loose = []
            add(child.name, [r for r in child.children if isinstance(r, Node) and r.name == "tr" and not hidden(r)])
        elif child.name == "caption":
            captions.append(child)
    add("tbody", loose)
    return captions, parts["thead"] + parts["tbody"] + parts["tfoot"]


def _stray(node: Node) -> list:
    """What a browser moves in front of a table: content outside its cells."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.append(c)
        elif c.name in ("tr", "tbody", "thead", "tfoot"):
            out += [x for x in _stray(c) if isinstance(x, str) or x.name not in ("td", "th")]
        elif c.name not in ("caption", "colgroup", "col", "td", "th"):
            out.append(c)
    return out


def _width(line: str) -> int:
    """Columns that a terminal or fixed font shows the line with."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Me", "Mn") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned lines of a table's cells (lines, colspan, rowspan)."""
    grid: list[dict[int, list[str]]] = []
    spans: dict[int, int] = {}
    wide: list[tuple[int, int, int]] = []
    for cells in rows:
        row, col = {}, 0
        taken, spans = spans, {c: n - 1 for c, n in spans.items() if n > 1}
        for lines, colspan, rowspan in cells:
            while taken.get(col, 0):
                col += 1
            row[col] = lines
            if colspan > 1:
                wide.append((col, colspan, max(map(_width, lines), default=0)))
            for c in range(col, col + colspan):
                if rowspan > 1:
                    spans[c] = rowspan - 1
            col += colspan
        grid.append(row)
    spanning = {(c, w) for c, n, w in wide}
    widths: dict[int, int] = {}
    for row in grid:
        for c, lines in row.items():
            w = max(map(_width, lines), default=0)
            if (c, w) not in spanning:
                widths[c] = max(widths.get(c, 0), w)
    columns = sorted(set(widths) | {c for row in grid for c in row})
    offset, at = {}, 0
    for c in columns:
        offset[c] = at
        at += widths.get(c, 0) + 2
    out = []
    for row in grid:
        for k in range(max((len(x) for x in row.values()), default=0)):
            line = ""
            for c, lines in sorted(row.items()):
                cell = lines[k] if k < len(lines) else ""
                if cell:
                    now = _width(line)
                    line += " " * (offset[c] - now) if now <= offset[c] else "  "
                    line += cell
            out.append(line)
    return out


def render(root: Node) -> str:
    """All visible text of the tree.  A stack holds what is still to be written; tables wait for their cells."""
    page = _Page()
    pages = [page]
    todo: list[tuple] = [("node", root, False, True)]
    ordered: list[list] = []
    while todo:
        kind, *rest = todo.pop()
        page = pages[-1]
        if kind == "text":
            if rest[2]:
                (page.exact if rest[1] else page.text)(rest[0])
        elif kind == "line":
            page.end()
        elif kind == "space":
            page.space()
        elif kind == "outdent":
            page.end()
            page.indent.pop()
            page.lead = ""
        elif kind == "endlist":
            ordered.pop()
        elif kind == "cell":
            cells, colspan, rowspan = rest
            cells.append((pages.pop().done().split("\n"), colspan, rowspan))
        elif kind == "newcell":
            pages.append(_Page())
        elif kind == "grid":
            page.space()
            for line in _grid(rest[0]):
                page.now.append(line)
                page.end(True)
            page.space()
        else:
            node, exact, seen = rest
            if hidden(node):
                continue
            seen = visible(node, seen)
            name, after = node.name, []
            if name == "br":
                page.end(True)
                continue
            if name == "hr":
                page.space()
                continue
            if name == "img":
                if seen and (alt := node.attrs.get("alt")):
                    page.text(alt)
                continue
            if name == "input":
                if seen and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and node.attrs.get("value"):
                    page.text(node.attrs["value"])
                continue
            if name == "wbr":
                continue
            if name == "table":
                captions, rows = _table(node)
                page.space()
                table: list[list] = []
                steps: list[tuple] = [("node", c, False, seen) for c in captions] + [("text" if isinstance(c, str) else "node", c, False, seen) for c in _stray(node)]
                for row in rows:
                    table.append([])
                    for cell, columns, taken in row:
                        inner = Node("div", {k: v for k, v in cell.attrs.items() if k == "style"})
                        inner.children = cell.children
                        steps += [("newcell",), ("node", inner, False, seen), ("cell", table[-1], columns, taken)]
                todo += reversed([*steps, ("grid", table)])
                continue
            if name in ("ul", "ol", "menu"):
                (page.end if ordered else page.space)()
                down = name == "ol" and "reversed" in node.attrs
                items = sum(isinstance(c, Node) and c.name == "li" and not hidden(c) for c in node.children)
                ordered.append([name == "ol", _number(node.attrs.get("start", ""), items if down else 1), -1 if down else 1])
                after = [("endlist",), ("line",) if len(ordered) > 1 else ("space",)]
            elif name == "li":
                page.end()
                if ordered and ordered[-1][0]:
                    value = _number(node.attrs.get("value", ""), ordered[-1][1])
                    ordered[-1][1] = value + ordered[-1][2]
                    mark = f"{value}. "
                else:
                    mark = "* "
                page.indent.append(" " * len(mark))
                page.lead = mark if seen else ""
                after = [("outdent",)]
            elif name in ("dd", "blockquote"):
                (page.space if name in SPACED else page.end)()
                page.indent.append("  ")
                after = [("outdent",)] + ([("space",)] if name in SPACED else [])
            elif name in SPACED:
                # A block that opens a list item stays on the marker's line.
                if not (page.lead and not page.now):
                    page.space()
                after = [("space",)]
            elif name in BLOCKS:
                if not (page.lead and not page.now):
                    page.end()
                after = [("line",)]
            elif name == "q" and seen:
                page.text("")
                todo.append(("text", "”", True, True))
                page.now.append(" “" if page.blank and page.now else "“")
                page.blank = False
            inner = exact or name in ("pre", "textarea", "xmp", "plaintext")
            children = node.children
            if name == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
            if name in ("pre", "textarea") and children and isinstance(children[0], str):
                children = [re.sub(r"^\r?\n", "", children[0]), *children[1:]]
            todo += reversed([*(("text" if isinstance(c, str) else "node", c, inner, seen) for c in children), *after])
    return pages[0].done()


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


def _extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(extract)


def extract_texts(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the visible text of each."""
    return pages.withColumn(text_col, F.pandas_udf(_extract, "string")(F.col(html_col).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract_texts(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
