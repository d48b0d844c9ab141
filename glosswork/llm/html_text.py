"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules and a renderer.

All visible text comes out, in order. Blocks stand on lines of their own, with a
blank line around paragraphs, headings, lists and tables; list items carry marks and
indents; cells of a table line up in the columns of a grid that spans keep free, those of several lines (lists, inner tables, wrapped text) line by line;
blocks within a cell go without blank lines, text's own blank lines stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import bound_batches, table

#: Lines of cells are wrapped at this width, so that one long cell doesn't blow up its column.
WRAP = 80

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f\xa0]+")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas svg math datalist title meta link base area".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset form details menu address".split())
BLOCK = PARAGRAPH | frozenset("html body div section article aside header footer nav main li dt dd figcaption summary legend caption center dialog search hgroup option optgroup tr td th thead tbody tfoot".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: An open element that a start tag ends, and elements past which the search for it doesn't go.
ENDS = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table"),
    "th": ("td th", "table"),
    "tr": ("tr td th", "table"),
    "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "body": ("head", "html"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements that a stray end tag inside doesn't reach past.
FENCES = frozenset("table td th caption object template html".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Tree:
    """Builds the tree: implied start and end tags are put in, unknown end tags are dropped, whatever is open at the end is closed."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.depth: dict[str, int] = {}

    def _close_to(self, n: int) -> None:
        for node in self.open[n:]:
            self.depth[node.tag] -= 1
        del self.open[n:]

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] = self.depth.get(tag, 0) + 1
        return node

    def _end(self, which: frozenset, fence: frozenset) -> None:
        """Close the outermost open element of ``which`` that lies inside the nearest of ``fence``."""
        if not any(self.depth.get(t) for t in which):
            return
        found = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in fence:
                break
            if self.open[i].tag in which:
                found = i
        if found:
            self._close_to(found)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            return
        if self.depth.get("head") and tag not in HEAD_ONLY and tag not in ("head", "body"):
            self._end(frozenset(["head"]), frozenset())  # content implies the end of the head
        if tag == "body" and self.depth.get("body"):
            return
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCK and self.depth.get("p"):
            self._end(frozenset(["p"]), FENCES)
        inside = self.depth.get("table")
        if tag in ("td", "th") and inside and not self._within("tr"):
            self.start("tr", {})
        elif tag == "tr" and inside and not (self._within("tbody") or self._within("thead") or self._within("tfoot")):
            self._push("tbody", {})
        self._push(tag, attrs)

    def _within(self, tag: str) -> bool:
        """Whether ``tag`` is open inside the nearest table."""
        if not self.depth.get(tag):
            return False
        for node in reversed(self.open):
            if node.tag == tag:
                return True
            if node.tag == "table":
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "p" and not self.depth.get("p"):
            self.start("p", {})  # a stray end tag stands for an empty paragraph
        if tag == "br":
            return self.start("br", {})
        if tag in ("html", "body") or not self.depth.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                return self._close_to(i)
            if self.open[i].tag in FENCES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "template", "object"):
                return

    def text(self, text: str) -> None:
        if self.depth.get("head") and not text.isspace():
            self._end(frozenset(["head"]), frozenset())
        self.open[-1].children.append(text)


def parse(source: str) -> Node:
    tree, at, n = Tree(), 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            tree.text(html.unescape(source[at:]))
            break
        m = _TOKEN.match(source, lt)
        if m is None:  # a bare "<" is text
            stop = source.find("<", lt + 1)
            stop = n if stop < 0 else stop
            tree.text(html.unescape(source[at:stop]))
            at = stop
            continue
        if lt > at:
            tree.text(html.unescape(source[at:lt]))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            tree.end(tag)
            continue
        tree.start(tag, attributes(m["attrs"] if m["tag"] else m["attrs2"]))
        if tag in RAW:  # nothing inside is markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, at)
            stop = end.start() if end else n
            if tag == "textarea" and stop > at:
                tree.open[-1].children.append(html.unescape(source[at:stop]))
            at = stop
            if not end:
                break
    return tree.root


def visible(node: Node) -> bool:
    """Whether a node and what is in it may be seen at all; ``seen`` is about its own text."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _HIDING.search(a["style"]))


def seen(node: Node, inherited: bool) -> bool:
    """Visibility of a node's own text: the last that its style names, else that of the node around it; what is in a hidden node may be visible again."""
    named = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else []
    return named[-1].lower() in ("visible", "initial") if named else inherited


def whole(node: Node, name: str, default: int, most: int) -> int:
    """A whole number given as an attribute."""
    given = node.attrs.get(name, "").strip()
    return min(int(given), most) if given.lstrip("-").isdigit() and len(given) < 9 else default


class Table:
    """Rows of cells on a grid; ``held`` tells for how many rows from here on each column is taken by a cell from above."""

    def __init__(self) -> None:
        self.rows: list[list[list[str]]] = []
        self.held: list[int] = []
        self.coming: list[int] = []

    def row(self) -> None:
        self.held = [max(a - 1, b) for a, b in zip_longest(self.held, self.coming, fillvalue=0)]
        self.coming = []
        self.rows.append([])

    def cell(self, lines: list[str], wide: int, tall: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        while len(row) < len(self.held) and self.held[len(row)] > 0:
            row.append([])
        self.coming += [0] * (len(row) - len(self.coming)) + [tall - 1] * wide
        row += [lines] + [[]] * (wide - 1)


class Lines:
    """Text flowing into lines; ``blank`` asks for an empty line before the next one, which the lines of a cell (``compact``) go without."""

    def __init__(self, compact: bool = False) -> None:
        self.compact = compact
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.blank = False
        self.mark, self.indent = "", [""]

    def flow(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words.endswith(" ")
        self.parts.append((" " if self.space and self.parts else "") + (words[:-1] if tail else words))
        self.space = tail

    def exact(self, text: str) -> None:
        pieces = text.split("\n")
        for i, piece in enumerate(pieces):
            if i:
                self.finish(True)
            if piece:
                self.parts.append(piece.rstrip("\r"))
        self.space = False

    def finish(self, even_empty: bool = False) -> None:
        """End the line that is being written."""
        text = "".join(self.parts).rstrip(" ")
        self.parts, self.space = [], False
        if text or even_empty and self.lines and self.lines[-1]:
            lead = self.indent[-1][: len(self.indent[-1]) - len(self.mark)] + self.mark
            self.put(lead + text if text else "")
            if text:
                self.mark = ""

    def put(self, line: str) -> None:
        if self.blank and not self.compact and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        self.lines.append(line.rstrip(" "))

    def apart(self) -> None:
        self.finish()
        self.blank = bool(self.lines)

    def done(self) -> list[str]:
        self.finish()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def wrapped(line: str) -> list[str]:
    """A line of a cell as lines of at most WRAP characters, cut at spaces; its own indent goes on. A longer word stays whole."""
    if len(line) <= WRAP:
        return [line]
    indent = line[: len(line) - len(line.lstrip(" "))]
    out, now = [], indent
    for word in line.split():
        if now.strip() and len(now) + 1 + len(word) > WRAP:
            out.append(now)
            now = indent
        now += (" " if now.strip() else "") + word
    return [*out, now]


def align(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells, each of some lines, as lines whose columns begin at the same place.

    A word that is wider than a column may be stands on a line of its own, under its column's beginning, unless nothing follows it.
    """
    rows = [[[part for line in cell for part in wrapped(line)] for cell in row] for row in rows]
    width: list[int] = []
    for row in rows:
        width += [0] * (len(row) - len(width))
        for i, cell in enumerate(row):
            width[i] = max([width[i], *(min(len(line), WRAP) for line in cell)])
    begin = [0, *accumulate(w + 2 for w in width)]
    out = []
    for row in rows:
        for n in range(max(map(len, row), default=0)):
            held = [cell[n] if n < len(cell) else "" for cell in row]
            last = max((i for i, text in enumerate(held) if text), default=0)
            wide = [i for i, text in enumerate(held) if len(text) > width[i] and i < last]
            line = "  ".join(("" if i in wide else text).ljust(w) for i, (text, w) in enumerate(zip(held, width, strict=False))).rstrip()
            if line or not wide:
                out.append(line)
            out += [" " * begin[i] + held[i] for i in wide]
    return out


def render(root: Node) -> str:
    """Text of the visible nodes. The walk keeps its own stack, so nesting of any depth is fine."""
    out = [Lines()]
    tables: list[Table] = []
    lists: list[list] = []
    pre = 0
    stack: list[tuple] = [("node", root, True)]
    while stack:
        kind, node, shown = stack.pop()
        if kind == "node":
            if isinstance(node, str):
                if shown:
                    out[-1].exact(node) if pre else out[-1].flow(node)
                continue
            if not visible(node):
                continue
            shown = seen(node, shown)
            tag, here = node.tag, out[-1]
            if tag == "br":
                here.finish(True)
                continue
            if tag == "hr":
                here.apart()
                continue
            if tag == "img":
                continue
            if tag in PARAGRAPH and not (tag in ("ul", "ol", "menu") and lists):
                here.apart()
            elif tag in BLOCK and tag not in ("td", "th"):
                here.finish()
            if tag in ("pre", "textarea"):
                pre += 1
            elif tag in ("ul", "ol", "menu"):
                back = tag == "ol" and "reversed" in node.attrs
                items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
                lists.append([tag, whole(node, "start", items, 10**8), -1 if back else 1])
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = whole(node, "value", lists[-1][1], 10**8)
                    here.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += lists[-1][2]
                else:
                    here.mark = "- "
                here.indent.append(here.indent[-1] + " " * len(here.mark))
                stack.append(("li", node, shown))
                stack.extend(("node", c, shown) for c in reversed(node.children))
                continue
            elif tag == "dd":
                here.indent.append(here.indent[-1] + "  ")
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th") and tables:
                out.append(Lines(compact=True))
            elif tag == "details" and "open" not in node.attrs:
                stack.append(("leave", node, shown))
                stack.extend(("node", c, shown) for c in reversed(node.children) if isinstance(c, Node) and c.tag == "summary")
                continue
            stack.append(("leave", node, shown))
            stack.extend(("node", c, shown) for c in reversed(node.children))
        elif kind == "li":
            out[-1].finish()
            out[-1].mark = ""
            out[-1].indent.pop()
        else:
            tag, here = node.tag, out[-1]
            if tag in ("pre", "textarea"):
                here.finish()
                pre -= 1
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag in ("td", "th") and tables:
                tall = whole(node, "rowspan", 1, 65_534) or 65_534  # none: to the end of the table
                tables[-1].cell(out.pop().done(), max(1, whole(node, "colspan", 1, 1000)), max(1, tall))
                continue
            elif tag == "dd":
                here.finish()
                here.indent.pop()
            elif tag == "table":
                here.apart()
                for line in align(tables.pop().rows):
                    here.put(here.indent[-1] + line)
            if tag in PARAGRAPH and not (tag in ("ul", "ol", "menu") and lists):
                here.apart()
            elif tag in BLOCK:
                here.finish()
    return "\n".join(out[0].done())


def page_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with a column of visible text in place of the html. Null and empty pages give empty text; no shuffle.

    A column already named like the result is replaced, other columns stay whatever their names. Rows that repeat are rendered each, pages of any length
    whole (one at a time, in memory in proportion to the page), and an empty table stays empty.
    """
    bound_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    rows = pages.select(*keep, F.col(html_col).alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([page_text(v.as_py()) for v in batch.column(text_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, text_col])

    return rows.mapInArrow(run, rows.schema)


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
