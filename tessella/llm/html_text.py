"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout.

The builder closes what authors leave open (paragraphs, list items, cells, the head), opens rows that are missing and
ignores end tags without a start. Not visible are the head, scripts, styles, templates, comments, elements with
``hidden`` or ``display:none`` (in their own style or by a style sheet's rule for one tag, class or id), invisible
inputs, the closed part of ``details`` and ``visibility:hidden`` text. All other text is rendered: inline text with white
space collapsed, blocks on lines of their own, paragraphs, headings, lists and tables between blank lines, list items
behind markers with nested lines indented, preformatted text as it is, and a table's cells aligned in columns.

A column is as wide as its widest cell, but at most ``WRAP`` characters: longer text is wrapped at spaces if another cell
follows it in its row. What can't be wrapped (words, preformatted text, tables within cells) sticks out of its column, and
the cells that follow in the row begin on the line below it. So every cell starts at its column, whatever the others
hold, without an output that grows by the widest cell times the rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a column at most.
WRAP = 60
#: Bounds of the HTML standard on spans of cells.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACED = HEADINGS | frozenset("p ul ol dl menu table blockquote pre figure hr fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article header footer nav main aside address li dt dd form figcaption details summary dialog "
    "center caption legend thead tbody tfoot tr td th optgroup option search hgroup".split()
)
#: Start tags that end an open paragraph.
ENDS_P = SPACED | frozenset(
    "div section article header footer nav main aside address li dt dd form figcaption details summary dialog center search hgroup".split()
)
#: For a start tag: the open elements that it ends, and the elements beyond which it doesn't look.
_CELL, _ROW = frozenset("td th".split()), frozenset("td th tr".split())
_GROUP = _ROW | frozenset("thead tbody tfoot caption colgroup".split())
_TABLE = frozenset(["table"])
IMPLIED_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu td th table".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl td th table".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl td th table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (_CELL, frozenset("tr table".split())),
    "th": (_CELL, frozenset("tr table".split())),
    "tr": (_ROW, _TABLE),
    "thead": (_GROUP, _TABLE),
    "tbody": (_GROUP, _TABLE),
    "tfoot": (_GROUP, _TABLE),
    "caption": (_GROUP, _TABLE),
    "colgroup": (_GROUP, _TABLE),
}
#: An end tag or an implied end of a paragraph doesn't reach beyond these.
SCOPE = frozenset("td th table caption button html".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\f\r]+")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list[Node | str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value
        out.setdefault(name.lower(), html.unescape(value))
    return out


class Builder:
    """Builds the tree of one document and gathers the selectors that its style sheets hide."""

    def __init__(self, source: str):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of each tag, where in ``open`` it stands
        self.blocks: list[int] = []  # where blocks stand
        self.unseen: set[str] = set()
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            start = source.find("<", at)
            if start < 0:
                start = end
            if start > at:
                self._text(html.unescape(source[at:start]))
            if start == end:
                break
            token = TOKEN.match(source, start)
            if not token:  # a lone "<" is text
                self._text("<")
                at = start + 1
                continue
            at = token.end()
            if not token[2]:
                continue
            tag = token[2].lower()
            if token[1]:
                self._end(tag)
                continue
            attrs = _attributes(token[3]) if token[3].strip(" /\t\n\r\f") else {}
            self._start(tag, attrs)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                raw = source[at : close.start() if close else end]
                at = close.end() if close else end
                self._raw(tag, raw)

    def _raw(self, tag: str, raw: str) -> None:
        if tag == "style":
            for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", raw, flags=re.DOTALL)):
                if NO_DISPLAY.search(body):
                    self.unseen.update(x for x in map(str.strip, selectors.split(",")) if re.fullmatch(r"[.#]?[\w-]+", x))
        self.open[-1].children.append(html.unescape(raw) if tag == "textarea" else raw)
        self._cut(len(self.open) - 1)

    def _text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip(" \t\n\f\r"):
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(text)

    def _ends(self, tags: frozenset[str], beyond: frozenset[str]) -> None:
        """Closes the outermost open element of ``tags`` within ``beyond``, with all that is open in it."""
        inmost = self._top(beyond)
        cuts = [at[i] for tag in tags if (at := self.places.get(tag)) and (i := bisect_right(at, inmost)) < len(at)]
        if cuts:
            self._cut(min(cuts))

    def _top(self, tags: frozenset[str]) -> int:
        """Where the innermost open element of ``tags`` stands; 0 without any."""
        return max((at[-1] for tag in tags if (at := self.places.get(tag))), default=0)

    def _cut(self, at: int) -> None:
        """Closes the open elements from ``at`` on."""
        for node in self.open[at:]:
            self.places[node.tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del self.open[at:]

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if self.open[-1].tag == "head":
                self._cut(len(self.open) - 1)
            if self.places.get(tag):
                return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in ENDS_P:
            self._ends(frozenset(["p"]), SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in IMPLIED_ENDS:
            self._ends(*IMPLIED_ENDS[tag])
        if tag in _CELL and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        if tag in ("body", "html"):  # what follows still belongs to the body
            return
        at = self._top(HEADINGS if tag in HEADINGS else frozenset([tag]))
        beyond = self._top(SCOPE) if tag not in _GROUP | _TABLE else 0
        if tag not in BLOCKS and self.blocks:
            beyond = max(beyond, self.blocks[-1])
        if at and at >= beyond:
            self._cut(at)


#: A step of the renderer: it yields the steps that it waits for, and gets the result of each.
Step = Generator["Step", object, object]


def _run(step: Step) -> object:
    """The result of a step, with the waiting ones on a list, so that no nesting is too deep."""
    waiting, result = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return result


class Fixed(str):
    """A line that isn't wrapped: preformatted, or laid out already."""


#: The indentation and list marker of a line, under which its continuations begin.
HANG = re.compile(r" *(?:(?:-|-?\d+\.) (?=.))?")


def wrapped(line: str) -> list[str]:
    """A line as several of at most ``WRAP`` characters where its spaces allow that."""
    if len(line) <= WRAP or isinstance(line, Fixed):
        return [line]
    head = HANG.match(line)[0]
    out, now, used = [], [], len(head)
    for word in line[len(head) :].split(" "):
        if now and used + 1 + len(word) > WRAP:
            out.append(" ".join(now))
            now, used = [], len(head)
        used += len(word) + bool(now)
        now.append(word)
    out.append(" ".join(now))
    return [(" " * len(head) if i else head) + x for i, x in enumerate(out)]


class Lines:
    """Lines of one block, with collapsed white space and at most one blank line between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.pending = False  # a space, if more text follows on this line
        self.fixed = False  # whether this line has preformatted text
        self.gap = 0

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def text(self, text: str) -> None:
        text = SPACES.sub(" ", text)
        body = text.strip(" ")
        if not body:
            self.pending |= bool(text and self.now)
            return
        if not self.now:
            self._begin()
        elif self.pending or text[0] == " ":
            self.now.append(" ")
        self.now.append(body)
        self.pending = text[-1] == " "

    def raw(self, text: str) -> None:
        first, *rest = text.split("\n")
        if first:
            if not self.now:
                self._begin()
            self.now.append(first)
            self.fixed = True
        for line in rest:
            self.line_break()
            if line:
                self.now.append(line)
                self.fixed = True
        self.pending = False

    def line_break(self) -> None:
        if not self.now:
            self._begin()
        line = "".join(self.now)
        self.lines.append(Fixed(line) if self.fixed else line)
        self.now, self.pending, self.fixed = [], False, False

    def block(self, gap: int) -> None:
        """Ends the line; ``gap`` 2 asks for a blank line before what follows."""
        if self.now:
            self.line_break()
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        if lines:
            self._begin()
            self.lines += lines

    def done(self) -> list[str]:
        self.block(0)
        lines = [type(x)(x.rstrip(" ")) if x[-1:] == " " else x for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Renderer:
    def __init__(self, tree: Builder):
        self.unseen = tree.unseen

    def _gone(self, node: Node) -> bool:
        """Whether an element and all within it take no part in the layout."""
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN or (tag == "dialog" and "open" not in attrs):
            return True
        if attrs and ("hidden" in attrs or NO_DISPLAY.search(attrs.get("style", ""))):
            return True
        if not self.unseen:
            return False
        names = [tag, *("." + x for x in attrs.get("class", "").split()), "#" + attrs.get("id", "")]
        return not self.unseen.isdisjoint(names)

    def children(self, node: Node, out: Lines, shown: bool = True, pre: bool = False) -> Step:
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    (out.raw if pre else out.text)(child)
            elif not self._gone(child):
                yield self._element(child, out, shown, pre)

    def _element(self, node: Node, out: Lines, shown: bool, pre: bool) -> Step:
        tag = node.tag
        if "style" in node.attrs and (seen := VISIBILITY.findall(node.attrs["style"])):
            shown = seen[-1].lower() == "visible"
        if tag == "br":
            out.line_break()
        elif tag == "input":
            if shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.text(f" {node.attrs.get('value', '')} ")
        elif tag == "table":
            yield self._table(node, out, shown)
        elif tag in ("ul", "ol", "menu"):
            yield self._list(node, out, shown)
        elif tag == "details" and "open" not in node.attrs:
            out.block(1)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary" and not self._gone(child):
                    yield self._element(child, out, shown, pre)
            out.block(1)
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            out.block(gap)
            yield self.children(node, out, shown, pre or tag == "pre")
            out.block(gap)
        else:
            yield self.children(node, out, shown, pre or tag in ("textarea", "xmp"))

    def _within(self, node: Node, shown: bool) -> Step:
        lines = Lines()
        yield self.children(node, lines, shown)
        return lines.done()

    def _list(self, node: Node, out: Lines, shown: bool) -> Step:
        out.block(2)
        number = _number(node.attrs.get("start"), 1)
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    out.text(child)
            elif child.tag != "li":
                if not self._gone(child):
                    yield self._element(child, out, shown, False)
            elif not self._gone(child):
                number = _number(child.attrs.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                out.block(1)
                lines = yield self._within(child, shown)
                out.add([type(x)((" " * len(mark) if i else mark) + x) if x else x for i, x in enumerate(lines)])
                out.block(1)
        out.block(2)

    def _table(self, node: Node, out: Lines, shown: bool) -> Step:
        out.block(2)
        rows: list[Node] = []
        yield self._rows(node, out, shown, rows)
        out.block(1)
        grid: list[Row] = []
        taken: dict[int, int] = {}  # rows that a column is still taken by a cell above
        for row in rows:
            cells, column = [], 0
            for cell in (x for x in row.children if isinstance(x, Node) and x.tag in _CELL and not self._gone(x)):
                while taken.get(column, 0) > 0:
                    column += 1
                wide = min(MAX_COLSPAN, max(1, _number(cell.attrs.get("colspan"), 1)))
                high = min(MAX_ROWSPAN, max(1, _number(cell.attrs.get("rowspan"), 1)))
                if lines := (yield self._within(cell, shown)):
                    cells.append((column, wide, lines))
                for i in range(column, column + wide):
                    taken[i] = high
                column += wide
            taken = {i: n - 1 for i, n in taken.items() if n > 1}
            grid.append(cells)
        out.add(_laid_out(grid))
        out.block(2)

    def _rows(self, node: Node, out: Lines, shown: bool, rows: list[Node]) -> Step:
        """Gathers the rows of a table; all else in it (captions, stray text) is rendered before them."""
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    out.text(child)
            elif self._gone(child):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield self._rows(child, out, shown, rows)
            elif child.tag == "tr":
                for x in child.children:
                    if isinstance(x, str):
                        if shown:
                            out.text(x)
                    elif x.tag not in _CELL and not self._gone(x):
                        yield self._element(x, out, shown, False)
                rows.append(child)
            else:
                yield self._element(child, out, shown, False)


#: The cells of a table's row that aren't empty: (column, columns, lines).
Row = list[tuple[int, int, list[str]]]


def _widths(rows: list[Row]) -> dict[int, int]:
    """The width of each column that has text. One that a wider cell spans is widened if a cell follows that."""
    widths: dict[int, int] = {}
    for column, wide, lines in chain.from_iterable(rows):
        if wide == 1:
            widths[column] = max(widths.get(column, 0), min(WRAP, max(map(len, lines))))
    for column, wide, lines in chain.from_iterable(cells[:-1] for cells in rows):
        if wide > 1:
            own = [x for x in range(column, column + wide) if x in widths]
            lacking = min(WRAP, max(map(len, lines))) - sum(widths[x] + 2 for x in own) + 2
            if lacking > 0:
                last = own[-1] if own else column
                widths[last] = widths.get(last, -2 if not own else 0) + lacking
    return widths


def _laid_out(grid: list[Row]) -> list[str]:
    """The lines of a table."""
    rows = [[(c, n, [y for x in lines for y in wrapped(x)]) for c, n, lines in cells[:-1]] + cells[-1:] for cells in grid]
    widths = _widths(rows)
    columns = sorted(widths)
    starts = list(accumulate((widths[c] + 2 for c in columns), initial=0))

    def start(column: int) -> int:
        return starts[bisect_left(columns, column)]

    out: list[str] = []
    for cells in rows:
        block: list[str] = []
        top = 0  # the line on which the next cell begins
        for i, (column, _, lines) in enumerate(cells):
            block += [""] * (top + len(lines) - len(block))
            for at, line in enumerate(lines, top):
                if line:
                    block[at] = block[at].ljust(start(column)) + line
            if i + 1 < len(cells):
                room = start(cells[i + 1][0]) - 2
                top = max((at for at, line in enumerate(block[top:], top + 1) if len(line) > room), default=top)
        out += map(Fixed, block)
    return out


def _number(raw: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", raw or "")
    return int(found[1]) if found else default


def visible_text(source: str | None) -> str:
    """The rendered text of a page; empty for null."""
    tree = Builder(source or "")
    out = Lines()
    _run(Renderer(tree).children(tree.root, out))
    return "\n".join(out.done()).replace("\xa0", " ")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of ``pages`` (page_id, html).

    Defined results: a null or empty page, and one without visible text, has an empty text; broken markup is text or
    ignored, never an error; very long and very deep pages are read whole; repeated rows give repeated results; a null
    page_id is passed on; an empty table gives an empty result; other columns are ignored.
    """

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([visible_text(x) for x in batch["html"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], texts], names=["page_id", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return common.arrow_map(rows, rendered, "page_id long, text string")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    found = extracted(common.table(spark, sf_dir, "pages", "page_id", "html"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
