"""Visible text of HTML pages, laid out: a small tree builder with implied tags, visibility rules and a renderer.

Blocks stand on lines of their own; paragraphs, headings, lists, tables and
quotes have a blank line around them. List items carry a dash or their number
(``start``, ``value`` and ``reversed`` count) and are indented by their depth. Cells of a
table are padded to the width of their column, wide characters counting twice;
what a cell holds in several lines, as lists and tables do, stays in several
lines; a cell that spans columns or rows keeps their places. Runs of white space
are one blank outside of ``pre``.

Not visible: head, script, style, template and comments; elements with
``hidden`` or ``display: none``; what inherits ``visibility: hidden`` and is not made
visible again; the inside of a closed ``details`` but its summary; a closed
``dialog``; alternative texts of media. Styles come from attributes and from the
rules of style elements with a simple selector (tag, .class, #id, tag.class,
tag#id) by their specificity and order. Rules inside of ``@media`` count where the medium is ``all``
or ``screen`` without further conditions, those of other conditional groups do
not. Scripts do not run, so that ``noscript`` is shown.

Defined cases: a null page has a null text, an empty one an empty text. Unclosed
tags, comments and quotes end with the page. Elements nested deeper than
``DEPTH`` become siblings, as in browsers; their text stays. Very long pages are
read whole; lines of a cell go on in the next line after ``CELL_WIDTH`` places, but in the last
cell of a row, so that one long cell does not widen all rows. Repeated rows get a row each. Other columns are not looked at.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.frames import pick

DEPTH, CELL_WIDTH = 200, 60
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"))
UNSEEN = frozenset(("head", "script", "style", "template", "title", "iframe", "noembed", "noframes", "audio", "video", "object", "canvas", "datalist", "param", "area", "rp"))
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu dir hr".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav search section summary optgroup option caption".split())
#: a start tag ends what is open up to the first of the second set
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",)))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
_BARRIER = frozenset(("table", "td", "th", "caption", "button", "template", "html"))
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|(?=\n)|\Z)|[{};]""", re.S)
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"\s*([a-zA-Z][\w-]*)?([.#][\w-]+)?\s*")
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    raw: str = ""
    children: list = field(default_factory=list)  # nodes and strings

    def attributes(self) -> dict[str, str]:
        if not self.raw:
            return {}
        out: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.raw):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return out


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack, at, ends = [root], 0, len(page)

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part) if "&" in part else part)

    def close(tags, barrier) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                last = i
                while last > 1 and stack[last - 1].tag in tags:
                    last -= 1
                del stack[last:]
                return
            if stack[i].tag in barrier:
                return

    while at < ends:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in _BARRIER and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            else:
                if tag == "p":
                    stack[-1].children.append(Node("p"))
            continue
        raw = m[3].rstrip(">")
        if tag == "html":
            root.raw = root.raw or raw
            continue
        if tag in BLOCK or tag == "table":  # an open paragraph ends at any block
            close(("p",), _BARRIER)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        node = Node(tag, raw)
        stack[-1].children.append(node)
        if tag in VOID or (raw.endswith("/") and tag in ("path", "circle", "rect", "line", "use", "polygon", "ellipse")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inside = page[at : end.start() if end else ends]
            at = end.end() if end else ends
            node.children.append(html.unescape(inside) if tag in ("textarea", "title") else inside)
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    return root


def _applies(group: str) -> bool:
    """Whether the rules inside of this group count on a screen of any size."""
    name, _, condition = group.partition(" ")
    if name.lower() == "@layer":
        return True
    return name.lower() == "@media" and any(c.strip().lower() in ("all", "screen", "only all", "only screen") for c in condition.split(","))


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selector, declarations) of the rules that count; rules inside of rules do not, blocks may be left open."""
    open_: list[list] = []  # kind, whether it counts, selector, declarations
    held, last = "", 0
    for m in [*_CSS.finditer(sheet), None]:
        held += sheet[last : m.start() if m else len(sheet)]
        last = m.end() if m else last
        token = m[0] if m else "}"
        if token[0] in "\"'":
            held += token
        elif token.startswith("/*"):
            held += " "
        elif token == ";":
            held = held + ";" if open_ and open_[-1][0] == "rule" else ""
        elif token == "{":
            counts = not open_ or (open_[-1][1] and open_[-1][0] == "group")
            if open_ and open_[-1][0] == "rule":
                done, _, held = held.rpartition(";")
                open_[-1][3] += done + ";"
            name = " ".join(held.split())
            open_.append(["group", counts and _applies(name), "", ""] if name.startswith("@") else ["rule", counts, name, ""])
            held = ""
        else:
            for _ in range(len(open_) if m is None else min(1, len(open_))):
                kind, counts, selector, declared = open_.pop()
                if kind == "rule" and counts:
                    yield selector, declared + held
                held = ""
            held = ""


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """Display and visibility of some declarations: (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for m in _STYLE.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", " ", style, flags=re.S)):
        name, found = m[1].lower(), (bool(m[3]), m[2].lower())
        if not (name in out and out[name][0] and not found[0]):
            out[name] = found
    return out


class _Styles:
    """What style elements say of display and visibility, by simple selectors."""

    def __init__(self):
        self.rules: dict[tuple[str, str], dict[str, tuple]] = {}
        self.count = 0

    def learn(self, sheet: str) -> None:
        for selectors, body in style_rules(sheet):
            said = declared(body)
            if not said:
                continue
            for selector in selectors.split(","):
                simple = _SELECTOR.fullmatch(selector)
                if simple and (simple[1] or simple[2]):
                    tag, name = (simple[1] or "").lower(), simple[2] or ""
                    self.count += 1
                    rank = (name.startswith("#"), name.startswith("."), bool(tag), self.count)
                    own = self.rules.setdefault((tag, name), {})
                    for key, (important, value) in said.items():
                        own[key] = max(own.get(key, ((False,), "")), ((important, *rank), value))

    def of(self, tag: str, given: dict[str, str]) -> dict[str, str]:
        """Display and visibility of an element, where anything is said of them."""
        best: dict[str, tuple] = {}
        if self.rules:
            names = ["", *("." + c for c in given.get("class", "").split())] + (["#" + given["id"]] if given.get("id") else [])
            for key in ((t, n) for n in names for t in (tag, "") if t or n):
                for what, ranked in self.rules.get(key, {}).items():
                    best[what] = max(best.get(what, ((False,), "")), ranked)
        if given.get("style"):
            for what, (important, value) in declared(given["style"]).items():
                best[what] = max(best.get(what, ((False,), "")), ((important, 2), value))  # above any selector
        return {what: value for what, (_, value) in best.items()}


def places(s: str) -> int:
    """Columns that a text takes: wide characters two, marks on other characters none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _broken(line: str) -> list[str]:
    """A line in lines of at most ``CELL_WIDTH`` places, between words."""
    out, size = [[]], 0
    for word in line.split(" "):
        n = places(word)
        if out[-1] and size + 1 + n > CELL_WIDTH:
            out.append([])
            size = 0
        size += n + bool(out[-1])
        out[-1].append(word)
    return [" ".join(words) for words in out]


def _number(value: str, low: int, high: int, else_: int) -> int:
    return min(max(int(value), low), high) if re.fullmatch(r"\s*\+?[0-9]{1,9}\s*", value) else else_


@dataclass
class Page:
    lines: list[str] = field(default_factory=list)
    items: int = 0
    tables: int = 0
    title: str | None = None


class _Layout:
    """Lines of one flow: the page, or a cell of a table."""

    def __init__(self, page: Page, styles: _Styles, shown: bool = True):
        self.page, self.styles, self.shown = page, styles, shown
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent, self.mark, self.gap = 0, "", False

    def word(self, s: str, keep: bool) -> None:
        if not self.shown:
            return
        if keep:
            first, *rest = s.split("\n")
            self.inline.append(first)
            for line in rest:
                self.flush(False, True)
                self.inline.append(line)
        else:
            self.inline.append(_SPACE.sub(" ", s))

    def flush(self, gap: bool, keep: bool = False) -> None:
        line = "".join(self.inline)
        self.inline = []
        if not keep:
            line = re.sub(" {2,}", " ", line).strip(" ")
        if line.strip() or (keep and self.lines):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((" " * max(self.indent - len(self.mark), 0) + self.mark + line).rstrip())
            self.mark = ""
        self.gap = self.gap or (gap and bool(self.lines))

    def enter(self, node: Node, given: dict[str, str]) -> bool | None:
        """Whether text in an element shows; None if the element is not there at all."""
        if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in given):
            return None
        said = self.styles.of(node.tag, given)
        if said.get("display") == "none" or ("hidden" in given and "display" not in said):
            return None
        visibility = said.get("visibility", "inherit")
        return visibility == "visible" if visibility in ("visible", "hidden", "collapse") else self.shown

    def walk(self, node: Node, keep: bool = False, order: list | None = None) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.word(child, keep)
                continue
            tag = child.tag
            given = child.attributes()
            shown = self.enter(child, given)
            if shown is None:
                continue
            before, self.shown = self.shown, shown
            self.element(child, tag, given, keep, order)
            self.shown = before

    def element(self, child: Node, tag: str, given: dict[str, str], keep: bool, order: list | None) -> None:
        if tag == "br":
            self.flush(False, keep)
        elif tag == "table":
            self.flush(True)
            self.table(child)
            self.gap = bool(self.lines)
        elif tag in BLOCK:
            self.block(child, given, keep, order)
        else:
            if tag in ("td", "th", "tr"):  # outside of a table
                self.word(" ", False)
            self.walk(child, keep, order)

    def block(self, node: Node, given: dict[str, str], keep: bool, order: list | None) -> None:
        tag = node.tag
        lists = tag in ("ul", "ol", "menu", "dir")
        spaced = tag in SPACED and not (lists and order is not None)
        self.flush(spaced, keep)
        if tag == "hr":
            return
        if lists:
            step = -1 if tag == "ol" and "reversed" in given else 1
            first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if step < 0 else 1
            start = given.get("start", "").strip()
            # the number of the next item, or none, and what it changes by
            self.walk(node, keep, [None if tag != "ol" else int(start) if re.fullmatch(r"[-+]?[0-9]{1,9}", start) else first, step])
        elif tag == "li":
            number = order[0] if order else None
            value = given.get("value", "").strip()
            if number is not None:
                number = int(value) if re.fullmatch(r"[-+]?[0-9]{1,9}", value) else number
                order[0] = number + order[1]
            mark = f"{number}. " if number is not None else "- "
            self.page.items += 1
            before, self.mark = self.mark, mark
            self.indent += len(mark)
            self.walk(node, keep, [None, 1])
            self.flush(False, keep)
            self.indent -= len(mark)
            self.mark = before if self.mark == mark else ""
        elif tag in ("blockquote", "dd"):
            self.indent += 2
            self.walk(node, keep, order)
            self.flush(spaced, keep)
            self.indent -= 2
        elif tag == "details" and "open" not in given:
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.walk(child, keep, order)
                    break
        else:
            if tag == "pre" and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
            self.walk(node, keep or tag == "pre", order)
        self.flush(spaced, keep or tag == "pre")

    def table(self, node: Node) -> None:
        self.page.tables += 1
        rows: list[dict[int, tuple[list[str], int]]] = []  # by the first column of a cell: its lines and its columns
        loose: list = []
        down: dict[int, int] = {}  # columns that a cell of an earlier row goes on in, and for how many rows

        def cell(child: Node, shown: bool) -> list[str]:
            inner = _Layout(self.page, self.styles, shown)
            inner.walk(child)
            inner.flush(False)
            return [x for x in inner.lines if x.strip()]

        def place(cells: list[tuple[list[str], int, int]]) -> None:
            row, at, longer = {}, 0, {}
            for lines, columns, height in cells:
                while down.get(at):
                    at += 1
                row[at] = (lines, columns)
                longer |= dict.fromkeys(range(at, at + columns), height - 1)
                at += columns
            rows.append(row)
            left = {c: n - 1 for c, n in down.items()} | longer
            down.clear()
            down.update({c: n for c, n in left.items() if n > 0})

        def gather(part: Node) -> None:
            cells: list[tuple[list[str], int, int]] = []
            for child in part.children:
                if isinstance(child, str):
                    if child.strip() and self.shown:
                        loose.append(child)
                    continue
                given = child.attributes()
                shown = self.enter(child, given)
                if shown is None:
                    continue
                before, self.shown = self.shown, shown
                if child.tag in ("td", "th"):
                    height = _number(given.get("rowspan", "1"), 0, 65_534, 1) or 65_534  # 0: to the end of its group
                    cells.append((cell(child, shown), _number(given.get("colspan", "1"), 1, 1000, 1), height))
                elif child.tag == "tr":
                    gather(child)
                elif child.tag in ("thead", "tbody", "tfoot"):
                    down.clear()
                    gather(child)
                    down.clear()
                elif child.tag == "caption":
                    self.walk(child)
                    self.flush(False)
                else:
                    loose.append(child)
                self.shown = before
            if cells:
                place(cells)
            elif part.tag == "tr":
                place([])

        gather(node)
        if loose:  # text and elements that stand in a table outside of its cells come before it
            self.walk(Node("div", "", loose))
            self.flush(False)
        width: dict[int, int] = {}
        for row in rows:
            last = max(row, default=0)
            for at, (lines, columns) in row.items():
                if at < last:
                    lines[:] = [y for x in lines for y in ([x] if places(x) <= CELL_WIDTH else _broken(x))]
                if columns == 1:
                    width[at] = max(width.get(at, 0), *(places(x) for x in lines if at < last or places(x) <= CELL_WIDTH), 0)
        spans = sorted((columns, at, max(map(places, lines), default=0)) for row in rows for at, (lines, columns) in row.items() if columns > 1 and at < max(row))
        for columns, at, size in spans:  # the last column of a span takes what the others leave over
            room = sum(width.get(at + c, 0) for c in range(columns)) + 3 * (columns - 1)
            width[at + columns - 1] = width.get(at + columns - 1, 0) + max(0, size - room)
        for row in rows:
            for i in range(max((len(lines) for lines, _ in row.values()), default=0)):
                at, parts = 0, []
                while at <= max(row):
                    lines, columns = row.get(at, ([], 1))
                    room = sum(width.get(at + c, 0) for c in range(columns)) + 3 * (columns - 1)
                    line = lines[i] if i < len(lines) else ""
                    parts.append(line + " " * (room - places(line)))
                    at += columns
                self.inline.append(" | ".join(parts).rstrip())
                self.flush(False, True)


def render(page: str | None) -> Page:
    """Lines of a page and what they hold."""
    out, styles = Page(), _Styles()
    if not page:
        return out
    root = parse(page)
    todo = [root]
    while todo:  # style elements and the title, wherever they stand
        node = todo.pop()
        for child in node.children:
            if isinstance(child, Node):
                if child.tag == "style":
                    styles.learn("".join(c for c in child.children if isinstance(c, str)))
                elif child.tag == "title" and out.title is None:
                    out.title = _SPACE.sub(" ", "".join(c for c in child.children if isinstance(c, str))).strip()
                todo.append(child)
    layout = _Layout(out, styles)
    layout.walk(root)
    layout.flush(False)
    out.lines = layout.lines
    return out


def extract(pages: DataFrame, *, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """Per page: page_id, title, text, n_lines (not blank), n_list_items and n_tables."""
    kept = pick(pages, page_id=page_id, html=page)

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for value in batch.column(1):
                source = value.as_py()
                done = render(source)
                out.append((done.title, None if source is None else "\n".join(done.lines), sum(map(bool, done.lines)), done.items, done.tables))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                                             names=["page_id", "title", "text", "n_lines", "n_list_items", "n_tables"])

    names = {"title": "string", "text": "string", "n_lines": "bigint", "n_list_items": "bigint", "n_tables": "bigint"}
    return kept.mapInArrow(run, kept.select("page_id", *[F.lit(None).cast(t).alias(n) for n, t in names.items()]).schema)
