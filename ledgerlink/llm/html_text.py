"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder with implied tags (p, li, tr, td, option ... close by themselves; head and
body are not needed). A renderer walks the tree: hidden parts are skipped, blocks are set apart, lists get
markers, table cells are aligned by column, white space collapses outside pre. All visible text is emitted.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*|</", re.S)
SIGN = re.compile("[>\"']")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)

# Fixed values of the HTML standard: void elements, raw text, blocks, hidden elements, what an opening tag closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes title textarea plaintext".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul caption tr".split()
)
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
HIDDEN = set("area base datalist head link meta noembed noframes param rp script style template title noscript iframe embed object audio video canvas".split())
P_CLOSERS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
TABLE_PARTS = {"tbody", "thead", "tfoot"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A table is aligned unless that would make its text more than so many times as long, and longer than so many characters.
ALIGNED_TIMES, ALIGNED_CHARS = 16, 1 << 16


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        value = m[2] or ""
        out.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


class Stack(list):
    """Open elements, and how many there are of each tag, so that what is not open is not looked for."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter = Counter()

    def push(self, node: Node) -> None:
        self[-1].children.append(node)
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, at: int) -> None:
        self.open.subtract(n.tag for n in self[at:])
        del self[at:]


class Tags:
    """Finds markup in time linear in the page: where a tag's attributes lead from a sign is found once for each sign."""

    def __init__(self, source: str):
        self.source, self.last = source, {c: source.rfind(c) for c in ">\"'"}
        self.ends: dict[int, int] = {}
        self.clear = (0, -1)  # from here there is no sign before there

    def next(self, at: int) -> tuple[int, int] | None:
        """Begin and end of the next comment, declaration or tag; a tag that never ends is text."""
        while m := START.search(self.source, at):
            token = m.group()
            if token[1] in "!?":
                return m.span()
            if m.start() < self.last[">"]:
                end = self.source.find(">", m.end()) + 1 if token == "</" else self._end(m.end())
                if end > 0:
                    return m.start(), end
            at = m.start() + 1
        return None

    def _sign(self, at: int) -> int:
        if not self.clear[0] <= at <= self.clear[1]:
            m = SIGN.search(self.source, at)
            self.clear = at, m.start() if m else len(self.source)
        return self.clear[1]

    def _end(self, at: int) -> int:
        passed, end = [], -1
        while (k := self._sign(at)) < len(self.source):
            if k in self.ends:
                end = self.ends[k]
                break
            passed.append(k)
            sign = self.source[k]
            if sign == ">":
                end = k + 1
                break
            if k >= self.last[sign]:
                break
            at = self.source.find(sign, k + 1) + 1
        self.ends.update(dict.fromkeys(passed, end))
        return end


def parse(source: str) -> Node:
    """A tree of Nodes and strings, of any depth."""
    root = Node("#root")
    stack = Stack(root)
    at, end, tags = 0, len(source), Tags(source)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < end:
        span = tags.next(at)
        if span is None:
            text(source[at:])
            break
        text(source[at : span[0]])
        at, token = span[1], source[span[0] : span[1]]
        if token.startswith("<![CDATA["):
            text(token[9:].removesuffix("]]>"))
            continue
        name = NAME.match(token)
        if name is None:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            _close(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, token[name.end() : -1])
        if tag in VOID or tag in RAW or node.attrs.endswith("/") and (stack.open["svg"] > 0 or stack.open["math"] > 0):
            stack[-1].children.append(node)
        else:
            stack.push(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            body = source[at : stop.start() if stop else end]
            if tag not in ("script", "style"):
                node.children.append(html.unescape(body))
            at = stop.start() if stop else end
            if stop:
                close = source.find(">", at)
                at = end if close < 0 else close + 1
    return root


def _imply(stack: Stack, tag: str) -> None:
    if tag in P_CLOSERS and stack.open["p"] > 0:
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t == "p":
                stack.cut(i)
                break
            if t in ("table", "td", "th", "button", "caption", "li", "blockquote", "div", "section", "article"):
                break
    if tag in CLOSES:
        closes, scope = CLOSES[tag]
        for i in range(len(stack) - 1, 0, -1) if any(stack.open[t] > 0 for t in closes) else ():
            t = stack[i].tag
            if t in scope:
                break
            if t in closes:
                while i > 1 and stack[i - 1].tag in closes:
                    i -= 1
                stack.cut(i)
                break
    if tag in ("td", "th") and stack[-1].tag in TABLE_PARTS | {"table"}:
        stack.push(Node("tr"))


def _close(stack: Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    match = HEADINGS if tag in HEADINGS else {tag}
    for i in range(len(stack) - 1, 0, -1) if any(stack.open[t] > 0 for t in match) else ():
        t = stack[i].tag
        if t in match:
            stack.cut(i)
            return
        if t in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
            return  # an end tag inside a cell does not reach out of it
    if tag == "p":
        stack[-1].children.append(Node("p"))


DECLARATION = re.compile(r"(?:[^;\"']|\"[^\"]*\"?|'[^']*'?)+")


def style(node: Node) -> dict[str, str]:
    """The declarations of a style attribute, names and values in lower case; quoted text in values is none of them."""
    out: dict[str, str] = {}
    if "style" in node.attrs.lower():
        for m in DECLARATION.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", " ", attributes(node.attrs).get("style", ""), flags=re.S)):
            name, colon, value = m.group().partition(":")
            if colon:
                out[name.strip().lower()] = value.partition("!")[0].strip().lower()
    return out


def visible(node: Node) -> bool:
    """Whether a node takes part in the layout at all; visibility alone is told by shown."""
    if node.tag in HIDDEN:
        return False
    raw = node.attrs
    if not raw or not ("hidden" in (low := raw.lower()) or "style" in low):
        return node.tag != "dialog" or "open" in raw.lower()
    a = attributes(raw)
    if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return style(node).get("display") != "none" and (node.tag != "dialog" or "open" in a)


def shown(node: Node, around: bool) -> bool:
    """Whether a node's own text shows: as around it, unless its style says otherwise."""
    own = style(node).get("visibility") if node.attrs else None
    return own == "visible" if own in ("visible", "hidden", "collapse") else around


SPACE = re.compile(r"[ \t\n\r\f]+")


#: Lines inside lists are indented by so many characters at most: deeper levels show by their markers alone.
MOST_INDENT = 64


class Writer:
    """Lines of text; blank lines and spaces are due rather than written, so that they collapse.

    Items of lists are levels: the first line of an item has its marker, and those of the items around it that have no
    line yet; other lines are indented. Inside items there are no blank lines.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = False
        self.widths: list[int] = []  # of the open items' markers; the last len(due) of them are not written yet
        self.due: list[str] = []
        self.indent = 0  # of those that are
        self.outer_gap = False

    def open_item(self, marker: str) -> None:
        self.block(False)
        if not self.widths:
            self.outer_gap = self.gap
        self.widths.append(len(marker))
        self.due.append(marker)

    def close_item(self) -> None:
        self.block(False)
        if self.due:
            self.item_line("")
        self.indent -= self.widths.pop()
        self.gap = False

    def item_line(self, line: str) -> None:
        if len(self.due) == len(self.widths) and self.outer_gap and self.lines:
            self.lines.append("")
        self.lines.append((" " * min(self.indent, MOST_INDENT) + "".join(self.due) + line).rstrip())
        self.indent += sum(map(len, self.due))
        self.due = []

    def inline(self, text: str) -> None:
        if not text:
            return
        body = SPACE.sub(" ", text)
        if body[0] == " ":
            self.space = True
            body = body[1:]
        if not body:
            return
        tail = body[-1] == " "
        if tail:
            body = body[:-1]
        if self.space and self.now:
            self.now.append(" ")
        self.now.append(body)
        self.space = tail

    def verbatim(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.now.append(first)
        for line in rest:
            self.newline(keep=True)
            self.now.append(line)

    def newline(self, keep: bool = False) -> None:
        line = "".join(self.now)
        self.now, self.space = [], False
        if self.widths:
            if line.strip():
                self.item_line(line)
        elif line.strip() or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(line.rstrip())

    def block(self, spaced: bool) -> None:
        if self.now:
            self.newline()
        self.gap |= spaced

    def text(self) -> str:
        self.block(False)
        return "\n".join(self.lines).strip("\n")


def width(s: str) -> int:
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def run(walk) -> None:
    """Walk a generator that yields the walks of its parts, one inside the other, without recursion."""
    stack = [walk]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        else:
            stack.append(part)


def render(node: Node, out: Writer, pre: bool = False, around: bool = True):
    """Write the children of a node; yields the walks of parts, for run. Around: whether text shows here."""
    ordered = 0
    if node.tag == "ol":
        start = attributes(node.attrs).get("start", "1")
        ordered = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if around:
                (out.verbatim if pre else out.inline)(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        seen = shown(child, around)
        if not seen and tag in ("br", "img", "input", "hr"):
            continue
        if tag == "br":
            out.newline(keep=True)
        elif tag == "img":
            out.inline(attributes(child.attrs).get("alt", ""))
        elif tag == "input":
            a = attributes(child.attrs)
            if a.get("type", "").lower() in ("button", "submit", "reset"):
                out.inline(a.get("value", ""))
        elif tag == "hr":
            out.block(True)
        elif tag == "table":
            out.block(True)
            lines: list[str] = []
            yield table_lines(child, lines, seen)
            for line in lines:
                out.now.append(line)
                out.newline(keep=True)
            out.block(True)
        elif tag == "li":
            out.block(False)
            marker = f"{ordered}. " if node.tag == "ol" else "- "
            ordered += 1
            if seen:
                out.open_item(marker)
                yield render(child, out, pre, seen)
                out.close_item()
            else:
                yield render(child, out, pre, seen)
                out.block(False)
        elif tag in BLOCK:
            spaced = tag in SPACED and not (tag in ("ul", "ol") and node.tag in ("li", "ul", "ol"))
            out.block(spaced)
            yield render(child, out, pre or tag in ("pre", "listing"), seen)
            out.block(spaced)
        elif tag in ("td", "th"):
            out.inline(" ")
            yield render(child, out, pre, seen)
            out.inline(" ")
        else:
            yield render(child, out, pre or tag == "textarea", seen)


def table_rows(node: Node) -> list[tuple[Node | str, bool]]:
    """Rows of a table and of its parts, in order, with True; and what else is shown between them, with False."""
    out: list[tuple[Node | str, bool]] = []
    left = list(reversed(node.children))
    while left:
        child = left.pop()
        if isinstance(child, str):
            if child.strip():
                out.append((child.strip(), False))
        elif visible(child):
            if child.tag in TABLE_PARTS:
                left += reversed(child.children)
            elif child.tag not in ("col", "colgroup"):
                out.append((child, child.tag == "tr"))
    return out


def _wrap(child: Node) -> Node:
    box = Node("#box")
    box.children = [child]
    return box


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; at most the number that the HTML standard allows."""
    n = attributes(cell.attrs).get(name, "1") if name in cell.attrs.lower() else "1"
    return max(1, min(int(n), most)) if n.isascii() and n.isdigit() else 1


def table_lines(node: Node, lines: list[str], around: bool = True):
    """Add the lines of a table: cells as columns of equal width, two spaces apart.

    A cell of several lines takes several lines. A cell that spans columns stands in its first one, one that
    spans rows in its first row; the cells of the rows after it keep clear of its columns.
    """
    rows: list[tuple[list[str] | None, dict[int, list[str]]]] = []
    busy: dict[int, int] = {}  # columns that cells of rows before reach into, and for how many rows yet
    for part, is_row in table_rows(node):
        if isinstance(part, str):
            if around:
                rows.append(([SPACE.sub(" ", part)], {}))
            continue
        if not is_row:
            inner = Writer()
            yield render(_wrap(part), inner, False, around)
            if text := inner.text():
                rows.append((text.split("\n"), {}))
            continue
        cells: dict[int, list[str]] = {}
        at, taken = 0, {c: n - 1 for c, n in busy.items() if n > 1}
        for cell in part.children:
            if isinstance(cell, str):
                if cell.strip() and shown(part, around):
                    while at in busy:
                        at += 1
                    cells[at] = [SPACE.sub(" ", cell).strip()]
                    at += 1
                continue
            if not visible(cell):
                continue
            inner = Writer()
            here = shown(part, around)
            yield render(cell if cell.tag in ("td", "th") else _wrap(cell), inner, False, shown(cell, here) if cell.tag in ("td", "th") else here)
            while at in busy:
                at += 1
            cells[at] = inner.text().split("\n")
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            if high > 1:
                taken.update(dict.fromkeys(range(at, at + wide), high - 1))
            at += wide
        busy = taken
        if any(any(c) for c in cells.values()):
            rows.append((None, cells))
    widths: dict[int, int] = {}
    for _, cells in rows:
        for i, c in cells.items():
            widths[i] = max(widths.get(i, 0), *map(width, c))
    columns = sorted(widths)  # those in which some cell begins
    size = sum(len(line) for _, cells in rows for c in cells.values() for line in c)
    across = sum(widths.values()) + 2 * len(columns)
    if across * sum(max(map(len, cells.values()), default=0) for _, cells in rows) > max(ALIGNED_CHARS, ALIGNED_TIMES * size):
        widths = dict.fromkeys(columns, 0)
    for caption, cells in rows:
        if caption is not None:
            lines += caption
            continue
        here = columns if any(widths.values()) else sorted(cells)
        for k in range(max(map(len, cells.values()))):
            parts = [(c[k] if k < len(c) else "") for c in (cells.get(i, ()) for i in here)]
            lines.append("  ".join(p + " " * (widths[i] - width(p)) for i, p in zip(here, parts, strict=True)).rstrip())


def html_to_text(source: str | None) -> str:
    if not source:
        return ""
    out = Writer()
    run(render(parse(source), out))
    return out.text()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """One row per row of pages: id_col, url_col (if named), text, n_lines, n_chars.

    Null and empty pages have the empty text. Markup that never closes, or closes twice, is repaired as
    browsers do; whatever is not hidden is emitted. What object, audio, video and canvas hold for browsers that cannot show
    them is hidden. Time and text grow in proportion to the page: indentation ends at MOST_INDENT characters. Ids may be null or repeat; other columns are ignored. An
    empty table gives an empty result.
    """
    keep = [id_col] + ([url_col] if url_col else [])

    def of(batches):
        for b in batches:
            texts = [html_to_text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    slim = pages.select(*keep, F.col(html_col).alias("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", text string"
    return slim.mapInArrow(of, schema).select(
        *keep, "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars")
    )
