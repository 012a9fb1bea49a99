"""HTML to text as it would be laid out: a tree with implied tags, then a text canvas.

All visible text is kept. Blocks start new lines, paragraphs and headings are set off by blank
lines, list items carry markers and indents, and table cells are aligned in columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

#: Fixed values of HTML: elements without content, whose content is not markup, and not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe noembed noframes object"
    " datalist audio video canvas".split()
)
#: Elements of drawings and formulas that are not shown, and what may stand in a head.
FOREIGN = frozenset(("svg", "math"))
UNSEEN_FOREIGN = frozenset(
    "desc metadata defs annotation annotation-xml symbol clippath mask marker pattern".split()
)
HEAD = frozenset("head html meta link base basefont bgsound title style script noscript noframes template".split())
#: Elements that begin a line of their own, and those set off by a blank line.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu"
    " nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul"
    " caption text".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr menu dir".split())
CLOSES_P = BLOCKS - frozenset("text body html li dd dt td th tr tbody thead tfoot option optgroup caption legend summary".split())
#: A start tag closes these open elements, up to but not beyond the named scopes.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements that are open at once; what is nested deeper stands beside the last one.
DEEPEST = 512
#: Cells wider than this are not padded, so one long cell does not widen a whole column.
WIDEST = 40


class Element:
    __slots__ = ("tag", "hidden", "kids", "start")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1) -> None:
        self.tag, self.hidden, self.start = tag, hidden, start
        self.kids: list[Element | str] = []


def _attributes(tag: str, text: str) -> tuple[bool, int]:
    """Whether the element is hidden, and the first number of a list."""
    hidden, start = tag in UNSEEN, 1
    low = text.lower()
    if "hidden" in low or "style" in low or "start" in low:
        for name, *values in _ATTRIBUTE.findall(text):
            name, value = name.lower(), html.unescape("".join(values))
            if name == "hidden" or (name == "style" and _HIDING.search(value)):
                hidden = True
            elif name == "type" and tag == "input" and value.lower() == "hidden":
                hidden = True
            elif name == "start" and tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", value.strip()):
                start = int(value)
    return hidden, start


class Tags:
    """The tags of a page one after another, in time linear in its length.

    A tag ends at the first ``>`` outside quotes, or at the first one at all where the quotes do
    not close. Where a scan outside quotes comes to is worked out once for all places, from
    the end of the page backwards, so a page full of open quotes is not scanned again and again.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.at = [m.start() for m in re.finditer("[\"'>]", page)]
        self.end = [-1] * (len(self.at) + 1)
        following = {'"': -1, "'": -1}
        for k in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[k]]
            if mark == ">":
                self.end[k] = self.at[k]
            else:
                closing = following[mark]
                self.end[k] = self.end[closing + 1] if closing >= 0 else -1
                following[mark] = k

    def next(self, at: int) -> tuple[int, int, re.Match | None, str] | None:
        """Start and end of the next tag, comment or declaration; a tag's name and what follows it."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                return start, len(page) if stop < 0 else stop + 3, None, ""
            if start > self.last:  # only a comment may still come
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            name = _NAME.match(page, start)
            if name:
                stop = self.end[bisect_left(self.at, name.end())]
                if stop < 0:
                    stop = page.find(">", name.end())
                return start, stop + 1, name, page[name.end() : stop]
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                return start, page.find(">", start) + 1, None, ""
            at = start + 1
        return None


def parse(page: str) -> Element:
    """The tree of a page; end tags that HTML lets one leave out are implied."""
    root = Element("#root")
    path, at, size = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # where each tag stands on the path
    tags = Tags(page)

    def pop() -> None:
        places[path.pop().tag].pop()

    def innermost(names: set) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: set, scopes: set) -> None:
        """Close the outermost open element of ``names`` inside the innermost scope."""
        inside = innermost(scopes)
        found = [own[k] for n in names if (own := places.get(n)) and (k := bisect_right(own, inside)) < len(own)]
        if found:
            while len(path) > min(found):
                pop()

    def text(raw: str) -> None:
        if raw:
            if path[-1].tag == "head" and _BLANK.sub("", raw):
                pop()
            path[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    while at < size:
        found = tags.next(at)
        if not found:
            text(page[at:])
            break
        text(page[at : found[0]])
        at, name, rest = found[1:]
        if not name:
            continue
        ending, tag = name[1], name[2].lower()
        if ending:
            if tag == "br":
                path[-1].kids.append(Element("br"))
            elif places.get(tag):
                barrier = innermost({"table"}) if tag not in ("table", "body", "html") else 0
                if places[tag][-1] > barrier:
                    stop = places[tag][-1]
                    while len(path) > stop:
                        pop()
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        elif tag not in ("html", "head") and tag in BLOCKS and places.get("head"):
            close({"head"}, set())
        elif path[-1].tag == "head" and tag not in HEAD:
            pop()
        if tag in CLOSES_P and places.get("p"):
            close({"p"}, {"table", "td", "th", "button", "object"})
        foreign = tag in FOREIGN or (any(places.get(t) for t in FOREIGN) and not places.get("foreignobject"))
        node = Element(tag, *_attributes(tag, rest))
        node.hidden |= foreign and tag in UNSEEN_FOREIGN
        path[-1].kids.append(node)
        if foreign and rest.endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            closed = page.find(">", stop.end()) if stop else -1
            inner = page[at : stop.start() if closed >= 0 else size]
            at = closed + 1 if closed >= 0 else size
            if inner:
                node.kids.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
        elif tag not in VOID and not (rest.endswith("/") and tag == "path"):
            if len(path) < DEEPEST:
                places.setdefault(tag, []).append(len(path))
                path.append(node)
    return root


class Canvas:
    """Lines of text; knows the open line, the blank lines due, the indent and the marker."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.due = self.indent = 0
        self.space = False
        self.marker = ""

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            for k, line in enumerate(text.split("\n")):
                if k:
                    self.end(force=True)
                if line:
                    self._put(line)
            return
        words = _BLANK.split(text)
        if not any(words):
            self.space |= bool(text)
            return
        lead = not words[0] or self.space
        self.space = not words[-1]
        body = " ".join(w for w in words if w)
        self._put(" " + body if self.open and lead else body)

    def _put(self, text: str) -> None:
        if not self.open:
            if self.due and self.lines:
                self.lines += [""] * (self.due - 1)
            self.due = 0
            self.open.append(" " * max(self.indent - len(self.marker), 0) + self.marker)
            self.marker = ""
        self.open.append(text)

    def end(self, gap: int = 1, force: bool = False) -> None:
        """End the open line; ``gap`` 2 asks for a blank line before the next one."""
        if self.open or force:
            self.lines.append("".join(self.open).rstrip())
            self.open = []
        self.space = False
        self.due = max(self.due, gap)

    def rows(self, rows: list[list[list[str]]]) -> None:
        """Table rows; each cell is a list of lines."""
        width: dict[int, int] = {}
        for row in rows:
            for k, cell in enumerate(row):
                for line in cell:
                    if len(line) <= WIDEST:
                        width[k] = max(width.get(k, 0), len(line))
        for row in rows:
            for n in range(max((len(cell) for cell in row), default=0)):
                parts = [(cell[n] if n < len(cell) else "").ljust(width.get(k, 0)) for k, cell in enumerate(row)]
                line = "  ".join(parts).rstrip()
                if line:
                    self._put(line)
                    self.end()

    def text(self) -> str:
        self.end(0)
        return "\n".join(self.lines).strip("\n")


def render(root: Element) -> str:
    """The visible text of a tree."""
    canvas, tables = Canvas(), []  # tables: the canvas around, rows, and whether a cell is open
    lists: list[list] = []
    keep = 0
    todo: list[tuple] = [("open", root)]
    while todo:
        step, node = todo.pop()
        if step == "text":
            canvas.write(node, keep > 0)
            continue
        tag = node.tag
        if step == "open":
            if node.hidden:
                continue
            if tag == "br":
                canvas.end(force=True)
                canvas.due = min(canvas.due, 1)
                continue
            if tag == "hr":
                canvas.end(2)
                canvas.write("---")
                canvas.end(2)
                continue
            if tag == "table":
                canvas.end(2)
                tables.append([canvas, [], False])
            elif tag == "tr" and tables:
                tables[-1][1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1][1]:
                    tables[-1][1].append([])
                canvas = Canvas()
            elif tag in BLOCKS:
                canvas.end(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([node.start if tag == "ol" else None, canvas.indent])
                canvas.indent += 2
            elif tag == "li":
                number = lists[-1][0] if lists else None
                canvas.marker = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1][0] += 1
                    canvas.indent = lists[-1][1] + max(len(canvas.marker), 2)
            elif tag in ("dd", "blockquote"):
                canvas.indent += 2
            elif tag == "pre":
                keep += 1
            todo.append(("close", node))
            for kid in reversed(node.kids):
                todo.append(("text", kid) if isinstance(kid, str) else ("open", kid))
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            canvas.end(1)
            canvas.indent = lists.pop()[1]
            canvas.due = max(canvas.due, 1 if lists else 2)
        elif tag in ("dd", "blockquote"):
            canvas.end(2 if tag == "blockquote" else 1)
            canvas.indent = max(canvas.indent - 2, 0)
        elif tag in ("td", "th") and tables:
            cell = [line for line in canvas.text().split("\n") if line]
            tables[-1][1][-1].append(cell)
            canvas = tables[-1][0]
        elif tag == "table":
            around, rows, _ = tables.pop()
            canvas = around
            canvas.rows(rows)
            canvas.due = 2
        else:
            if tag == "pre":
                keep -= 1
            if tag == "li":
                canvas.marker = ""
            if tag in BLOCKS:
                canvas.end(2 if tag in SPACED else 1)
    return canvas.text()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Id and ``text`` of every page. A null page gives a null text, an empty one an empty text."""

    def extract(batches):
        for batch in batches:
            texts = [None if p is None else render(parse(p)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{html_col}`").alias("_html"))
    return narrow.mapInArrow(extract, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
