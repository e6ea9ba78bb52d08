"""Visible text of HTML pages by layout-aware rendering.

A small tree builder (implied end tags and rows, void and raw-text elements, content moved out of tables) feeds a renderer
with visibility rules (display, visibility and its overrides, by own styles and by simple rules of style elements, hidden,
closed details), the shown options of selects, text of svg and math, block spacing, list markers, preformatted text and tables whose cells are aligned in columns, with column and row spans. Each page is a row of its
own: nothing is shuffled.

Null html: null text (n_chars 0). Empty html: empty text. Broken markup never raises: a "<" that opens no tag, or a tag
without an end, is text; unclosed elements close with their parent. Elements may be nested to any depth, and the work is
linear in the page: open elements are found by tag, rendering keeps its own stack, and indents and alignment stop at
INDENT levels and PAD characters. Repeated rows are each rendered; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Levels of lists that are indented, characters of a column and of a row that cells are aligned by, columns of a cell.
INDENT, PAD, ROW_PAD, SPANS = 24, 60, 400, 1000
#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
HIDDEN = frozenset("script style head title meta link noscript template iframe noframes object audio video canvas datalist base param source track area map".split())
#: Elements of svg and math that aren't rendered; their nodes are named apart.
UNSEEN = frozenset("desc metadata defs symbol annotation annotation-xml clippath mask".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li legend summary".split())
#: Which open elements a start tag ends, and where the search for them stops.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("caption", "colgroup"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)), "body": (("head",), ("html",)),
}
#: Elements whose content is rows or cells only; what else stands there moves before the table, as in browsers.
ROWED = frozenset("table thead tbody tfoot tr colgroup".split())
#: Parts of a table, and the open elements that each stands in.
PARTS = dict.fromkeys(("td", "th"), ROWED - {"colgroup"}) | {"tr": ROWED - {"tr", "colgroup"}, "col": frozenset(("table", "colgroup"))} | dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), frozenset(("table",)))
OPENS = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?]))")
TAG_END = re.compile("[>\"']")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?\*/", re.S)
#: A rule of a style sheet, an at-rule's head, or a closing brace; and a selector of a tag, classes or an id alone.
RULE = re.compile(r"([^{}@;]+)\{([^{}]*)\}|@[^{};]*([{;])|[{}]")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE_RUN = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "source", "children", "_attributes", "_stated", "sheet")

    def __init__(self, tag: str, source: str = ""):
        self.tag, self.source, self.children, self._attributes, self._stated, self.sheet = tag, source, [], None, None, None

    def get(self, name: str) -> str | None:
        """An attribute; of repeated ones the first counts."""
        if not self.source:
            return None
        if self._attributes is None:
            self._attributes = {}
            for m in ATTRIBUTE.finditer(self.source):
                self._attributes.setdefault(m[1].lower(), next((html.unescape(v) for v in m.groups()[1:] if v is not None), ""))
        return self._attributes.get(name)

    def hidden(self) -> bool:
        """Whether neither the element nor anything in it is rendered."""
        if self.tag in HIDDEN or self.tag.startswith("unseen "):
            return True
        if self.tag == "dialog" and self.get("open") is None:
            return True
        display = self.stated("display")
        return display == "none" or display is None and bool(self.source) and self.get("hidden") is not None

    def stated(self, name: str) -> str | None:
        """The value of display or visibility by its own style or the page's sheets: importance first, then the own style, then the last."""
        if not self.source and self.sheet is None:
            return None
        if self._stated is None:
            own = declared(self.get("style") or "") if self.source else {}
            sheet = self.sheet or {}
            first = {k: v for k, v in sheet.items() if v[0] and not own.get(k, (False,))[0]}  # only an important rule wins over the own style
            self._stated = {k: v for k, (_, v) in (sheet | own | first).items()}
        return self._stated.get(name)

    def shown(self, inherited: bool) -> bool:
        """Whether its own text can be seen; visibility is inherited until an element states it."""
        stated = self.stated("visibility")
        return stated not in ("hidden", "collapse") if stated and stated not in ("inherit", "unset") else inherited


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """What a style declares of display and visibility: (whether it is important, value); of several the last, important ones first."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARATION.findall(style):
        if bool(important) or not found.get(name.lower(), (False,))[0]:
            found[name.lower()] = (bool(important), value.lower())
    return found


class Sheet:
    """Rules of a page's style elements on display and visibility, by selectors of a tag, classes or an id alone.

    Rules in at-rules (media queries) and of other selectors aren't followed.
    """

    def __init__(self, texts: list[str]):
        self.rules: list[tuple[tuple, str, frozenset, frozenset, dict]] = []
        depth = 0
        for m in RULE.finditer(COMMENT.sub(" ", "\n".join(texts))):
            if m[1] is None:
                depth = depth + 1 if m[3] == "{" or m[0] == "{" else max(0, depth - 1) if m[0] == "}" else depth
                continue
            stated = declared(m[2]) if not depth else {}
            for one in m[1].split(",") if stated else ():
                s = SELECTOR.fullmatch(one.strip())
                if s and s[0]:
                    names = re.findall(r"[.#][\w-]+", s[2])
                    ids, classes = ([x[1:] for x in names if x[0] == k] for k in "#.")
                    tag = "" if s[1] in (None, "*") else s[1].lower()
                    self.rules.append(((len(ids), len(classes), bool(tag)), tag, frozenset(ids), frozenset(classes), stated))
        self.rules.sort(key=lambda r: r[0])

    def apply(self, root: Node) -> None:
        stack = [root]
        while stack:
            x = stack.pop()
            stack += [y for y in x.children if isinstance(y, Node)]
            classes, ids = frozenset((x.get("class") or "").split()), {x.get("id")}
            for _, tag, wanted, own, stated in self.rules:
                if tag in ("", x.tag) and wanted <= ids and own <= classes:
                    x.sheet, x._stated = x.sheet or {}, None
                    x.sheet |= {k: v for k, v in stated.items() if v[0] or not x.sheet.get(k, (False,))[0]}


class Open:
    """The open elements, with the places of each tag, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Close the k-th element and all in it."""
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def last(self, *tags: str) -> int:
        """The innermost place of any of the tags; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def first_after(self, k: int, *tags: str) -> int:
        """The outermost place beyond k of any of the tags; 0 if there is none."""
        found = [at[i] for t in tags if (at := self.places.get(t)) and (i := bisect_right(at, k)) < len(at)]
        return min(found, default=0)

    def table(self) -> int:
        """Where the table stands whose rows or cells come next; 0 if the innermost element isn't of that kind."""
        return self.last("table") if self.stack[-1].tag in ROWED else 0

    def add(self, x: Node | str) -> None:
        """Put x into the innermost element, or before the table if it can't stand among rows or cells."""
        moves = x.strip() if isinstance(x, str) else x.tag not in PARTS and not x.hidden()
        k = self.table() if moves else 0
        if k:
            self.stack[k - 1].children.insert(-1, x)
        else:
            self.stack[-1].children.append(x)

    def to_table(self, tag: str) -> None:
        """End what a part of a table can't stand in, up to its row, section or table; a cell outside a row gets one."""
        k = self.last(*ROWED, "td", "th", "caption")
        while k and self.stack[k].tag in ROWED and self.stack[k].tag not in PARTS[tag]:
            k -= 1
        if not k or self.stack[k].tag not in ROWED:
            return
        self.cut(k + 1)
        if tag in ("td", "th") and self.stack[k].tag != "tr":
            row = Node("tr")
            self.stack[k].children.append(row)
            self.push(row)


def tag_end(source: str, at: int) -> int:
    """Where the ">" of a tag stands, -1 if nowhere. Quoted values may hold one; a quote that never closes is a character."""
    while m := TAG_END.search(source, at):
        if m[0] == ">":
            return m.start()
        close = source.find(m[0], m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def tree(source: str) -> Node:
    """The element tree of a page."""
    root = Node("html")
    opened, at, size, styles = Open(root), 0, len(source), []
    while at < size:
        m = OPENS.search(source, at)
        if m is None:
            opened.add(html.unescape(source[at:]))
            break
        if m.start() > at:
            opened.add(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1] or m[4]:
            mark = "-->" if m[1] else ">"
            end = source.find(mark, at)
            at = size if end < 0 else end + len(mark)
            continue
        end = tag_end(source, at)
        if end < 0:
            opened.add(html.unescape(source[m.start() :]))
            break
        tag, attributes, at = m[3].lower(), source[at:end], end + 1
        if tag in UNSEEN and opened.last("svg", "math"):
            tag = f"unseen {tag}"
        if m[2]:
            k = opened.last(tag)
            if k:
                if tag in ("table", "html", "body") or opened.last("table") < k:
                    opened.cut(k)
            elif tag == "p":
                opened.stack[-1].children.append(Node("p"))
            continue
        if tag in CLOSES_P:
            k = opened.last("p")
            if k > opened.last("td", "th", "li", "div", "table", "button"):
                opened.cut(k)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            k = opened.first_after(opened.last(*stops), *ends)
            if k:
                opened.cut(k)
        among_rows = opened.table()
        if tag in PARTS:
            opened.to_table(tag)
        elif tag == "table" and among_rows:
            opened.cut(among_rows)
        node = Node(tag, attributes)
        opened.add(node)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math") or tag == "form" and among_rows:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else size
            node.children.append(source[at:stop] if tag in ("script", "style") else html.unescape(source[at:stop]))
            if tag == "style":
                styles.append(source[at:stop])
            close = source.find(">", stop) if end else -1
            at = size if close < 0 else close + 1
            continue
        opened.push(node)
    if any("display" in s or "visibility" in s for s in map(str.lower, styles)) and (sheet := Sheet(styles)).rules:
        sheet.apply(root)
    return root


class Page:
    """Lines of text with the blank lines that blocks ask for."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0

    def text(self, s: str) -> None:
        s = SPACE_RUN.sub(" ", s)
        if not self.parts or self.parts[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
        if s:
            self.parts.append(s)

    def literal(self, s: str) -> None:
        *full, last = s.replace("\r\n", "\n").split("\n")
        for x in full:
            self.parts.append(x)
            self.end(True)
        if last:
            self.parts.append(last)

    def end(self, always: bool = False) -> None:
        """End the line, if it has anything or always."""
        line = "".join(self.parts).rstrip()
        if line or always:
            if self.lines and self.gap and line:
                self.lines += [""] * self.gap
            self.gap = 0 if line else self.gap
            self.lines.append(line)
        self.parts = []

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = 1

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")

    def flat(self) -> str:
        """All on one line."""
        return " ".join(x.strip() for x in self.done().split("\n") if x.strip())


class List:
    """An open list: its parent, level, whether it is numbered, and the next number."""

    def __init__(self, node: Node, parent: List | None):
        start = node.get("start") or ""
        self.level, self.numbered = parent.level + 1 if parent else 0, node.tag == "ol"
        self.next = int(start) if start.lstrip("-").isdecimal() and len(start) < 10 else 1

    def marker(self, value: str) -> str:
        number = int(value) if value.lstrip("-").isdecimal() and len(value) < 10 else self.next
        self.next = number + 1
        return "  " * min(self.level, INDENT) + (f"{number}. " if self.numbered else "- ")


def run(first: Iterator) -> None:
    """Run a generator and those it yields, each to its end, without recursion."""
    stack = [first]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def span_of(cell: Node, name: str, most: int) -> int:
    n = cell.get(name) or ""
    return min(int(n), most) if n.isdecimal() and len(n) < 10 and (int(n) or name == "rowspan") else 1


def sections(table: Node) -> Iterator[list[Node]]:
    """The rows of each section; rows that stand in the table itself are a section."""
    own: list[Node] = []
    for x in table.children:
        if isinstance(x, Node) and not x.hidden():
            if x.tag == "tr":
                own.append(x)
            elif x.tag in ("thead", "tbody", "tfoot"):
                if own:
                    yield own
                    own = []
                yield [r for r in x.children if isinstance(r, Node) and r.tag == "tr" and not r.hidden()]
    if own:
        yield own


def render_table(table: Node, page: Page, lists: List | None, shown: bool) -> Iterator:
    """Caption and what stands outside cells first, then the rows; a cell that spans columns or rows keeps them free."""
    for x in table.children:
        if isinstance(x, Node) and x.tag == "caption" and not x.hidden():
            inside = Page()
            yield render(x, inside, None, x.shown(shown))
            page.text(inside.flat())
            page.end()
        elif isinstance(x, str):
            if x.strip() and shown:
                page.text(x)
                page.end()
        elif not x.hidden() and x.tag not in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col"):
            yield render_child(x, page, lists, shown)
            page.end()
    rows: list[dict[int, str]] = []
    for section in sections(table):
        taken: dict[int, int] = {}  # column: rows of this section that a cell above still spans
        for n, row in enumerate(section):
            taken = {c: k for c, k in taken.items() if k > n}
            cells, column = {}, 0
            for cell in row.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th") or cell.hidden():
                    continue
                while column in taken:
                    column += 1
                inside = Page()
                yield render(cell, inside, None, cell.shown(row.shown(shown)))
                if text := inside.flat():
                    cells[column] = text
                wide, high = span_of(cell, "colspan", SPANS), span_of(cell, "rowspan", len(section) - n)
                if high != 1:
                    taken |= dict.fromkeys(range(column, column + wide), n + high if high else len(section))
                column += wide
            if cells:
                rows.append(cells)
    widths: dict[int, int] = {}
    for cells in rows:
        for c, text in cells.items():
            widths[c] = max(widths.get(c, 0), min(len(text), PAD))
    offsets, at = {}, 0
    for c in sorted(widths):
        offsets[c] = min(at, ROW_PAD)
        at += widths[c] + 2
    for cells in rows:
        parts, length = [], 0
        for c, text in cells.items():
            gap = max(offsets[c] - length, 2 if parts else 0)
            parts += [" " * gap, text]
            length += gap + len(text)
        page.literal("".join(parts))
        page.end()


def every_text(node: Node, shown: bool) -> Iterator[str]:
    stack = [(x, shown) for x in reversed(node.children)]
    while stack:
        x, seen = stack.pop()
        if isinstance(x, str):
            if seen:
                yield x
        elif x.tag == "br":
            yield "\n"
        elif not x.hidden():
            stack += [(y, x.shown(seen)) for y in reversed(x.children)]


def options(select: Node, listed: bool) -> list[str]:
    """The labels of a select that can be seen: all of a list, else that of the last selected option, or of the first that isn't disabled."""
    found, stack = [], list(reversed(select.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node) and not x.hidden():
            if x.tag == "option":
                found.append(x)
            elif x.tag == "optgroup" and listed and x.get("label"):
                found.append(x)
            stack += reversed(x.children) if x.tag != "option" else ()
    label = lambda x: x.get("label") or " ".join("".join(every_text(x, True)).split())
    if not listed:
        chosen = [x for x in found if x.get("selected") is not None][-1:] or [x for x in found if x.get("disabled") is None][:1]
        found = chosen
    return [s for s in map(label, found) if s]


def render_child(x: Node, page: Page, lists: List | None, shown: bool) -> Iterator:
    if x.hidden():
        return
    tag, shown = x.tag, x.shown(shown)
    if tag == "br":
        page.end(True)
    elif tag == "hr":
        page.block(False)
    elif tag == "table":
        page.block(True)
        yield render_table(x, page, lists, shown)
        page.block(True)
    elif tag == "pre":
        page.block(True)
        page.literal("".join(every_text(x, shown)).strip("\n"))
        page.block(True)
    elif tag in ("ul", "ol", "menu"):
        page.block(not lists)
        yield render(x, page, List(x, lists), shown)
        page.block(not lists)
    elif tag == "li":
        page.end()
        marker = lists.marker(x.get("value") or "") if lists else "- "
        page.parts = [marker]
        yield render(x, page, lists, shown)
        if page.parts == [marker]:
            page.parts = []
        page.end()
    elif tag == "details" and x.get("open") is None:
        page.block(False)
        summary = next((c for c in x.children if isinstance(c, Node) and c.tag == "summary"), None)
        if summary:
            yield render_child(summary, page, lists, shown)
        page.block(False)
    elif tag == "select":
        listed = x.get("multiple") is not None or (x.get("size") or "") not in ("", "0", "1")
        for option in options(x, listed):
            page.text(" " + option)
            if listed:
                page.end()
        page.text(" ")
    elif tag in BLOCKS:
        page.block(tag in SPACED)
        yield render(x, page, lists, shown)
        page.block(tag in SPACED)
    else:
        yield render(x, page, lists, shown)
        if tag in ("td", "th", "text"):
            page.text(" ")


def render(node: Node, page: Page, lists: List | None, shown: bool) -> Iterator:
    for x in node.children:
        if isinstance(x, str):
            if shown:
                page.text(x)
        else:
            yield render_child(x, page, lists, shown)


def visible_text(source: str | None) -> str | None:
    """All visible text of a page; null stays null."""
    if source is None:
        return None
    page = Page()
    run(render(tree(source), page, None, True))
    return page.done()


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text and n_chars of every page."""

    @F.pandas_udf("string")
    def text_of(sources):
        return sources.map(visible_text)

    rows = pages.select(F.col(id_col), text_of(F.col(html_col)).alias("text"))
    return rows.select(id_col, "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))
