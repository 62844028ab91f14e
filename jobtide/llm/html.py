"""HTML extraction by layout-aware rendering.

A scanner cuts the markup in tags and text, a tree builder adds the tags that the markup implies (a paragraph ends where a block
begins, an item where the next begins, rows and cells likewise, void elements have no content), and a renderer walks the tree: what is
not visible gives nothing (scripts, styles, heads, templates, the attribute hidden, display: none, visibility: hidden, closed details and dialogs),
inline text is one flow with single spaces, blocks stand on lines of their own, paragraphs, headings, lists and tables are set
off by an empty line, items have their marks and indents, preformatted text stays as it is, and the cells of a table are aligned
in columns.

Defined results: null or empty markup gives an empty text; markup that ends within a tag or a comment loses that tag or comment;
nesting may be of any depth (the walk has its own stack; tables are set from the innermost on); a very long page is one page like any other, whose
tree must fit in a task; extra columns are not looked at;
repeated rows are rendered each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import ship

CELL_GAP = "  "
#: The most columns and rows that a cell may span.
ACROSS, DOWN = 1000, 65_534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist svg math".split())
#: Blocks; those in APART have an empty line before and after.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure menu listing xmp".split())
BLOCK = APART | frozenset(
    "address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav option optgroup search section select summary "
    "caption colgroup thead tbody tfoot tr td th hr".split()
)
#: A tag that begins ends these open ones, unless one of the fences stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
PARAGRAPH_ENDS = BLOCK - {"html", "body", "option", "optgroup", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}
FENCE = frozenset(["table", "td", "th", "button", "caption"])
HEAD_CONTENT = frozenset("base link meta noscript script style template title".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    @property
    def visible(self) -> bool:
        if self.tag in HIDDEN:
            return False
        if not self.attributes:
            return self.tag != "dialog"
        if self.get("hidden") is not None or (self.tag == "dialog" and self.get("open") is None):
            return False
        style = self.get("style")
        return not (style and _UNSEEN.search(style))


def tokens(markup: str):
    """(kind, name, rest): "text", "start" or "end"."""
    at, n, tag, last = 0, len(markup), _TAG, markup.rfind(">")
    while at < n:
        lt = markup.find("<", at)
        if lt < 0:
            yield "text", "", markup[at:]
            return
        if lt > at:
            yield "text", "", markup[at:lt]
        two = markup[lt + 1 : lt + 2]
        if two in ("!", "?"):
            if markup.startswith("<!--", lt):
                end = markup.find("-->", lt + 2)
                at = n if end < 0 else max(end + 3, lt + 5)
            elif markup.startswith("<![CDATA[", lt):
                end = markup.find("]]>", lt)
                yield "text", "", markup[lt + 9 : end if end >= 0 else n].replace("&", "&amp;")
                at = n if end < 0 else end + 3
            else:
                end = markup.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        letter = markup[lt + 2 : lt + 3] if two == "/" else two
        if not (letter.isascii() and letter.isalpha()):
            if two == "/":
                end = markup.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "&lt;"
                at = lt + 1
            continue
        if lt > last:
            return  # the markup ends within a tag
        m = tag.match(markup, lt)
        if m is None:
            tag = _LOOSE  # a quote that never ends: from here on, tags end at the next >
            m = tag.match(markup, lt)
        name, at = m[2].lower(), m.end()
        yield ("end" if m[1] else "start"), name, m[3]
        if not m[1] and name in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{name}[\s/>]", re.I).search(markup, at)
            end = close.start() if close else n
            if name in ("textarea", "title", "xmp"):
                yield "text", "", markup[at:end]
            at = end


def build(markup: str) -> Node:
    """The tree, with the implied html, head and body folded into one root."""
    root = Node("body", "", None)
    now = root
    open_tags = {"body": 1}

    def close_to(node: Node) -> None:
        nonlocal now
        while now is not node:
            open_tags[now.tag] -= 1
            now = now.parent

    def end(names, fences) -> None:
        """Close the innermost open element of names, with all inside, again and again up to a fence."""
        if not any(open_tags.get(x) for x in names):
            return
        node, found = now, None
        while node is not None and node.tag not in fences:
            if node.tag in names:
                found = node
            node = node.parent
        if found is not None:
            close_to(found.parent)

    for kind, name, rest in tokens(markup):
        if kind == "text":
            if now.tag == "head" and not rest.isspace():
                close_to(now.parent)
            now.children.append(rest)
        elif kind == "start":
            if name in ("html", "body"):
                if open_tags.get("head"):
                    end({"head"}, ())
                if rest and not root.attributes and name == "body":
                    root.attributes = rest
                continue
            if open_tags.get("head") and now.tag == "head" and name not in HEAD_CONTENT:
                end({"head"}, ())
            if name in ENDS:
                end(*ENDS[name])
            if name in PARAGRAPH_ENDS and open_tags.get("p"):
                end({"p"}, FENCE)
            node = Node(name, rest.strip().rstrip("/") if rest else "", now)
            now.children.append(node)
            if name not in VOID:
                now = node
                open_tags[name] = open_tags.get(name, 0) + 1
        elif name == "br":
            now.children.append(Node("br", "", now))
        elif name == "p" and not open_tags.get("p"):
            now.children.append(Node("p", "", now))
        elif open_tags.get(name) and name not in ("html", "body"):
            node = now
            fences = ("table",) if name not in ("table",) and name in BLOCK else ()
            while node is not None and node.tag != name and node.tag not in fences:
                node = node.parent
            if node is not None and node.tag == name:
                close_to(node.parent)
    return root


class _Flow:
    """Lines of text; a gap of 1 asks for a new line, 2 for an empty line before what comes next."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str) -> None:
        s = _BLANKS.sub(" ", unescape(s))
        if s == " ":
            self.space = self.space or bool(self.now)
            return
        if s[:1] == " ":
            s, self.space = s[1:], self.space or bool(self.now)
        tail = s[-1:] == " "
        if not s:
            return
        self._open()
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(s[:-1] if tail else s)
        self.space = tail

    def _open(self) -> None:
        if self.gap and not self.now and self.lines and self.gap == 2 and self.lines[-1] != "":
            self.lines.append("")
        self.gap = 0

    def end_line(self) -> None:
        if self.now:
            lead = "".join(self.indent)
            if self.mark:
                lead = "".join(self.indent[:-1]) + self.mark
                self.mark = ""
            self.lines.append(lead + "".join(self.now))
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def line_break(self) -> None:
        if self.now:
            self.end_line()
        elif self.lines and self.lines[-1] != "":
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        """Lines that stay as they are."""
        if lines:
            self.end_line()
            self._open()
            lead = "".join(self.indent)
            self.lines += [(lead + x).rstrip() for x in lines]


def _plain(node: Node) -> str:
    """The text of a preformatted element."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(unescape(x))
        elif x.tag == "br":
            out.append("\n")
        elif x.visible:
            stack += reversed(x.children)
    return "".join(out)


def _cells(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of cells of a table."""
    captions, rows, stack = [], [], [*reversed(table.children)]
    row: list[Node] | None = None
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                captions.append(_wrap([x], table))
        elif not x.visible:
            continue
        elif x.tag == "tr":
            row = []
            rows.append(row)
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("td", "th"):
                    if c.visible:
                        row.append(c)
                elif isinstance(c, Node) or c.strip():
                    captions.append(_wrap([c], table))
            row = None
        elif x.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
            row.append(x)
        elif x.tag in ("thead", "tbody", "tfoot", "colgroup"):
            stack += reversed(x.children)
        elif x.tag != "col":
            captions.append(x)
    return captions, rows


def _wrap(children: list, parent: Node) -> Node:
    out = Node("div", "", parent)
    out.children = children
    return out


def _table(table: Node, done: dict[int, list[str]]) -> list[str]:
    """The lines of a table, its captions first; done has those of the tables within it."""
    captions, rows = _cells(table)
    grid: list[list[str]] = []
    down: dict[int, int] = {}  # columns that a cell above still holds
    for row in rows:
        line: list[str] = []

        def skip():
            while down.get(len(line), 0) > 0:
                down[len(line)] -= 1
                line.append("")

        for cell in row:
            skip()
            text = " ".join(" ".join(x.split()) for x in _lines(cell.children, done) if x.strip())
            across, deep = _number(cell.get("colspan"), ACROSS), _number(cell.get("rowspan"), DOWN)
            for i in range(across):
                down[len(line)] = deep - 1
                line.append("" if i else text)
        skip()
        grid.append(line)
    grid = [x for x in grid if any(x)]
    width = [max((len(x[i]) for x in grid if i < len(x)), default=0) for i in range(max(map(len, grid), default=0))]
    keep = [i for i, w in enumerate(width) if w]
    above = [y for c in captions for y in _lines([c], done) if y.strip()]
    return above + [CELL_GAP.join((x[i] if i < len(x) else "").ljust(width[i]) for i in keep).rstrip() for x in grid]


def _number(value: str | None, most: int) -> int:
    return min(max(int(value[:9]), 1), most) if value and value.strip().isdecimal() else 1


def _lines(children: list, tables: dict[int, list[str]]) -> list[str]:
    flow, stack = _Flow(), [(x, 0) for x in reversed(children)]
    counters: list[int | None] = []
    while stack:
        x, done = stack.pop()
        if isinstance(x, str):
            flow.text(x)
            continue
        tag = x.tag
        if done:
            if tag in ("ul", "ol", "menu"):
                counters.pop()
            if tag == "li" or tag == "dd" or tag == "blockquote":
                flow.end_line()
                flow.indent.pop()
                flow.mark = ""
            flow.block(2 if tag in APART and not (tag in ("ul", "ol", "menu") and counters) else 1)
            continue
        if not x.visible:
            continue
        if tag == "br":
            flow.line_break()
        elif tag == "wbr" or tag in VOID and tag != "hr":
            continue
        elif tag == "pre" or tag == "listing" or tag == "xmp":
            flow.block(2)
            body = _plain(x)
            flow.whole((body[1:] if body[:1] == "\n" else body).rstrip().split("\n") if body.strip() else [])
            flow.block(2)
        elif tag == "table":
            flow.block(2)
            flow.whole(tables.pop(id(x), []))
            flow.block(2)
        elif tag in BLOCK:
            flow.block(2 if tag in APART and not (tag in ("ul", "ol", "menu") and counters) else 1)
            if tag in ("ul", "ol", "menu"):
                first = x.get("start") if tag == "ol" else None
                counters.append((int(first) if first and first.strip().lstrip("-").isdecimal() else 1) if tag == "ol" else None)
            elif tag == "li":
                mark = "- "
                if counters and counters[-1] is not None:
                    mark = f"{counters[-1]}. "
                    counters[-1] += 1
                flow.indent.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("dd", "blockquote"):
                flow.indent.append("  ")
            children = x.children
            if tag == "details" and x.get("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag != "hr":
                stack.append((x, 1))
                stack += [(c, 0) for c in reversed(children)]
        elif tag == "q":
            stack += [("”", 0), *((c, 0) for c in reversed(x.children)), ("“", 0)]
        else:
            stack += [(c, 0) for c in reversed(x.children)]
    flow.end_line()
    return flow.lines


def render(markup: str | None) -> str:
    if not markup:
        return ""
    root = build(markup)
    if not root.visible:
        return ""
    found, stack, tables = [], [root], {}
    while stack:  # a table comes before those within it
        x = stack.pop()
        if x.tag == "table":
            found.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node) and c.visible]
    for x in reversed(found):
        tables[id(x)] = _table(x, tables)
    lines = _lines(root.children, tables)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(x.rstrip() for x in lines).lstrip("\n")


def extract(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """One row a page: key, text, n_chars."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [render(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [key, "text", "n_chars"])

    return pages.select(pages[key].cast("long").alias(key), pages[markup].alias("markup")).mapInArrow(run, f"{key} long, text string, n_chars long")


def op4(pages: DataFrame) -> DataFrame:
    return extract(pages)
