"""Text of web pages by layout-aware rendering: a tree with implied tags, rules of visibility, and a renderer of blocks.

All visible text comes out, in the order of the page: paragraphs and headings with a blank line between, lists with
markers and indentation, table cells in aligned columns (spanned rows and columns included), preformatted text as it
stands, formulas and the text of drawings, values of form fields. What a browser doesn't show is left out: head, scripts,
styles, templates, comments, and elements hidden by attribute, inline style or the page's style sheets. Of those, rules
whose selectors are made of tags, classes, ids, attributes, descendants and children count, in the order of their weight;
`visibility` is inherited, so a visible child of an invisible element comes out. Content of `details` counts as opened.
What stands in a table outside of its cells comes before the table, as in a browser.

Broken markup never fails: unknown and unclosed tags are taken as they come, stray end tags are dropped, and elements
nested deeper than MAX_DEPTH join the element at that depth. A null page renders to null, an empty one to an empty text.
Pages are rendered one by one on the executors; repeated pages render alike. Null page ids and extra columns don't matter.
Columns of a table are as wide as their widest cell; only where blanks would outgrow PAD_FACTOR times the table's text are
the widest ones aligned to less, which keeps memory in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, PAD_FACTOR = 200, 8
# The largest spans that HTML allows.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534
# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())
READ = frozenset("textarea title xmp plaintext style".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes audio video canvas datalist title meta link base param source track annotation annotation-xml desc metadata defs".split())
#: Types of input whose value isn't shown as text.
WORDLESS = frozenset("hidden password checkbox radio file color range".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt caption option optgroup legend".split())
#: An opening tag of the key ends open elements of the first set, unless one of the second set is met before.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: End tags don't reach across these.
SCOPE = frozenset("table td th caption html template".split())
#: Where markup begins, and a tag from there on: quotes count after an equals sign only.
MARK = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|/?[A-Za-z])")
TAG = re.compile(r"""<(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])))*+)>""")
#: A tag whose quotes never end.
BROKEN_TAG = re.compile(r"<(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>]*)>")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
BLANK = re.compile(r"[ \t\n\r\f]+")
PROPERTY = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMMENT = re.compile(r"/\*.*?\*/", re.S)
STEP = re.compile(r"\s*([>\s])\s*(?=[^>\s])|\s*$")
SIMPLE = re.compile(r"""\*|([.#]?)([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*["']?([^"'\]]*)["']?\s*)?\]""")


class Node:
    __slots__ = ("attrs", "children", "display", "name", "visible")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []
        self.display, self.visible = "", True


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTR.finditer(text):
        value = m[2] or ""
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        found.setdefault(m[1].lower(), unescape(value))
    return found


def parse(html: str) -> Node:
    """Tree of a page under a root node without a name."""
    root = Node("", {})
    stack, at = [root], 0

    def add_text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    def pop_to(names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """End the outermost open element of names above any of stops."""
        k = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                k = i
            if stack[i].name in stops:
                break
        if k is not None:
            del stack[k:]

    last = html.rfind(">") + 1  # no tag ends after it
    while True:
        m = MARK.search(html, at)
        if not m or (m.start() >= last and not m["comment"]):
            break
        add_text(unescape(html[at : m.start()]))
        at = m.end()
        if m["comment"]:
            short = 1 if html.startswith(">", at) else 2 if html.startswith("->", at) else 0
            end = None if short else COMMENT_END.search(html, at)
            at = at + short if short else end.end() if end else len(html)
            continue
        if m["other"]:
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
            continue
        m = TAG.match(html, m.start(), last) or BROKEN_TAG.match(html, m.start(), last)
        at = m.end()
        name = m["name"].lower()
        if m["close"]:
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not any(n.name == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                    if stack[i].name in SCOPE and name not in SCOPE and name not in ("tr", "tbody", "thead", "tfoot", "body"):
                        break
            continue
        if name in CLOSES_P:
            pop_to({"p"}, {"table", "td", "th", "button", "li", "div", "section", "article"})
        if name in IMPLIED:
            pop_to(*IMPLIED[name])
        if name in ("html", "body") and any(n.name == name for n in stack):
            continue
        node = Node(name, attributes(m["attrs"]))
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at) if name != "plaintext" else None
            stop = end.start() if end else len(html)
            if name in READ:
                node.children.append(unescape(html[at:stop]) if name in ("textarea", "title") else html[at:stop])
            close = html.find(">", stop) if end else -1
            at = len(html) if close < 0 else close + 1
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    add_text(unescape(html[at:]))
    return root


# --- style sheets -------------------------------------------------------------------------------------------------


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet, with those of media rules for screens."""
    at = 0
    while True:
        begin = sheet.find("{", at)
        if begin < 0:
            return
        head, depth, end = sheet[at:begin].rpartition(";")[2].strip() if "@" in sheet[at:begin] else sheet[at:begin].strip(), 1, begin + 1
        while depth and end < len(sheet):
            depth += {"{": 1, "}": -1}.get(sheet[end], 0)
            end += 1
        body = sheet[begin + 1 : end - (depth == 0)]
        if not head.startswith("@"):
            yield head, body
        elif re.fullmatch(r"@media\s+(?:only\s+)?(?:all|screen)", head, re.I):
            yield from rules(body)
        at = end


class Selector:
    """Compound selectors from right to left, with what ties each to the next: a blank or ">"."""

    def __init__(self, text: str):
        self.steps: list[tuple[str, list[tuple[str, str, str | None]]]] = []
        at, tie, weight = 0, " ", [0, 0, 0]
        while at < len(text):
            parts = []
            while m := SIMPLE.match(text, at):
                kind = m[1] or ("[" if m[3] else "" if m[2] else "*")
                parts.append((kind, (m[2] or m[3] or "").lower() if kind in ("", "[") else m[2] or "", m[4]))
                weight[{"#": 0, ".": 1, "[": 1, "": 2}.get(kind, 2)] += kind != "*"
                at = m.end()
            step = STEP.match(text, at)
            if not parts or not step:
                raise ValueError(text)
            self.steps.insert(0, (tie, parts))
            tie = ">" if step[1] == ">" else " "
            at = step.end()
        if not self.steps:
            raise ValueError(text)
        self.weight = tuple(weight)

    @staticmethod
    def fits(parts: list, node: Node) -> bool:
        a = node.attrs
        for kind, name, value in parts:
            if kind == "#":
                ok = a.get("id") == name
            elif kind == ".":
                ok = name in a.get("class", "").split()
            elif kind == "[":
                ok = name in a and (value is None or a[name] == value)
            else:
                ok = kind == "*" or node.name == name
            if not ok:
                return False
        return True

    def matches(self, node: Node, above: list[Node]) -> bool:
        """Compounds tied by ">" are a chain; of every further chain the nearest place decides, as it leaves the most above."""
        at, k = 0, len(above) + 1
        while at < len(self.steps):
            size = 1
            while self.steps[at + size - 1][0] == ">" and at + size < len(self.steps):
                size += 1
            chain = [parts for _, parts in self.steps[at : at + size]]
            for j in range(k - 1, size - 2, -1) if at else (k - 1,):
                if j - size + 1 >= 0 and all(self.fits(parts, above[j - i] if j - i < len(above) else node) for i, parts in enumerate(chain)):
                    break
            else:
                return False
            at, k = at + size, j - size + 1
        return True


class Sheet:
    """Rules on display and visibility, found by the id, class or tag of the element that they are about."""

    def __init__(self, texts: list[str]):
        self.by_key: dict[str, list] = {}
        n = 0
        for text in texts:
            for heads, body in rules(COMMENT.sub("", text)):
                said = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in PROPERTY.finditer(body)]
                for head in heads.split(",") if said else ():
                    try:
                        selector = Selector(head.strip())
                    except ValueError:  # a kind of selector that isn't covered
                        continue
                    n += 1
                    parts = sorted((p for p in selector.steps[0][1] if p[0] in ("#", ".", "")), key=lambda p: ("#", ".", "").index(p[0]))
                    key = parts[0][0] + parts[0][1] if parts else "*"
                    self.by_key.setdefault(key, []).append((selector, n, said))

    def about(self, node: Node, above: list[Node]) -> dict[str, str]:
        """The values that win, inline style included."""
        keys = ["*", node.name]
        if "id" in node.attrs:
            keys.append("#" + node.attrs["id"])
        keys += ["." + c for c in dict.fromkeys(node.attrs.get("class", "").split())]
        found = [(important, s.weight, n, p, v) for k in keys for s, n, said in self.by_key.get(k, ()) if s.matches(node, above) for p, v, important in said]
        if "style" in node.attrs:
            found += [(bool(m[3]), (9, 9, 9), 0, m[1].lower(), m[2].lower()) for m in PROPERTY.finditer(node.attrs["style"])]
        return {p: v for _, _, _, p, v in sorted(found)}


def apply_styles(root: Node) -> None:
    """Set display and visible of every element."""
    sheets: list[str] = []

    def collect(node: Node) -> None:
        for c in node.children:
            if isinstance(c, Node):
                if c.name == "style":
                    sheets.extend(x for x in c.children if isinstance(x, str))
                collect(c)

    collect(root)
    sheet = Sheet(sheets)

    def walk(node: Node, above: list[Node], visible: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                continue
            a = c.attrs
            hidden = "hidden" in a or (c.name == "input" and a.get("type", "").lower() == "hidden") or (c.name == "dialog" and "open" not in a) or (c.name == "object" and bool(a.get("data")))
            said = sheet.about(c, above)
            c.display = "none" if c.name in HIDDEN else said.get("display") or ("none" if hidden else "")
            c.visible = {"visible": True, "hidden": False, "collapse": False}.get(said.get("visibility", ""), visible)
            if c.display != "none":
                walk(c, [*above, c], c.visible)

    walk(root, [], True)


def is_hidden(node: Node) -> bool:
    return node.display == "none"


def is_block(node: Node) -> bool:
    if node.display:
        return not node.display.startswith(("inline", "contents")) and node.name not in ("br",)
    return node.name in BLOCK or node.name == "text"  # of a drawing


class Writer:
    """Collects lines: gaps between blocks, indentation, and markers before the first text of a list item."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap, self.indent, self.marker = 0, "", ""

    def text(self, s: str) -> None:
        s = BLANK.sub(" ", s)
        if not self.line:
            s = s.lstrip(" ")
        elif self.line[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def flush(self) -> None:
        s = "".join(self.line).rstrip(" ")
        self.line = []
        if s:
            self.put(s)

    def put(self, s: str) -> None:
        if self.out:
            self.out.append("\n" * max(1, self.gap))
        lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent
        self.out.append(lead + s)
        self.gap, self.marker = 1, ""

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def span(cell: Node, name: str, most: int) -> int:
    n = cell.attrs.get(name, "1").strip()
    return min(max(1, int(n[:6])), most) if n.isascii() and n.isdigit() else 1


def column_widths(rows: list[list[list[str]]]) -> list[int]:
    """Width of the widest line of each column's cells, the last of a row aside, which needs no blanks after it; less for the
    widest where the blanks would outgrow the text."""
    widths = [0] * max(map(len, rows), default=0)
    text = height = 0
    for r in rows:
        for i, lines in enumerate(r):
            widths[i] = max(widths[i], *map(len, lines)) if i < len(r) - 1 and lines else widths[i]
            text += sum(map(len, lines))
        height += max(map(len, r), default=0)
    limit = PAD_FACTOR * text + 10_000
    while widths and sum(widths) * height > limit and max(widths) > 1:
        most = max(widths) // 2
        widths = [min(w, most) for w in widths]
    return widths


def render_table(table: Node, w: Writer) -> None:
    rows: list[list[list[str]]] = []  # the lines of each cell
    spanned: dict[int, int] = {}  # columns taken by cells from above, and for how many more rows

    def loose(nodes: list) -> None:
        if nodes:
            holder = Node("div", {})
            holder.children, holder.visible = nodes, table.visible
            render(holder, w)
            w.block(1)

    def has_cells(node: Node) -> bool:
        return any(isinstance(c, Node) and c.name != "table" and (c.name in ("td", "th") or has_cells(c)) for c in node.children)

    def cells_of(row: Node, found: list[Node]) -> list[Node]:
        """Cells of a row, also those inside other elements; all else goes before the table."""
        other = []
        for c in row.children:
            if isinstance(c, Node) and c.name in ("td", "th"):
                if not is_hidden(c):
                    found.append(c)
            elif isinstance(c, Node) and c.name != "table" and has_cells(c):
                if not is_hidden(c):
                    cells_of(c, found)
            else:
                other.append(c)
        loose(other)
        return found

    def add_row(cells: list[Node]) -> None:
        line: list[list[str]] = []
        begun: dict[int, int] = {}

        def skip() -> None:
            while spanned.get(len(line), 0) > 0:
                line.append([])

        for c in cells:
            skip()
            inner = Writer()
            render(c, inner)
            inner.flush()
            across, down = span(c, "colspan", MAX_COLSPAN), span(c, "rowspan", MAX_ROWSPAN)
            for i in range(across):
                if down > 1:
                    begun[len(line)] = down - 1
                line.append([] if i or not inner.out else "".join(inner.out).split("\n"))
        for i in list(spanned):
            spanned[i] -= 1
            if spanned[i] <= 0:
                del spanned[i]
        spanned.update(begun)
        while line and not line[-1]:
            line.pop()
        rows.append(line)

    def walk(node: Node) -> None:
        other, bare = [], []
        for c in node.children:
            if isinstance(c, Node) and c.name in ("td", "th"):  # cells without a row
                bare.append(c)
                continue
            if bare:
                add_row([x for x in bare if not is_hidden(x)])
                bare = []
            if isinstance(c, str) or c.name not in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
                if isinstance(c, Node) and c.name != "table" and not is_hidden(c) and has_cells(c):
                    walk(c)
                else:
                    other.append(c)
                continue
            if is_hidden(c):
                continue
            if c.name == "tr":
                add_row(cells_of(c, []))
            elif c.name == "caption":
                render(c, w)
                w.block(1)
            else:
                walk(c)
                if c.name in ("tbody", "thead", "tfoot"):
                    spanned.clear()
        if bare:
            add_row([x for x in bare if not is_hidden(x)])
        loose(other)

    walk(table)
    widths = column_widths(rows)
    for r in rows:
        for k in range(max(map(len, r), default=0)):
            line = "  ".join((c[k] if k < len(c) else "").ljust(widths[i] if i < len(r) - 1 else 0) for i, c in enumerate(r)).rstrip()
            if line:
                w.put(line)
            else:
                w.gap = max(w.gap, 2)


def field_text(node: Node) -> str:
    """What an input or an empty text area shows."""
    kind = node.attrs.get("type", "text").lower() if node.name == "input" else "text"
    if kind in WORDLESS:
        return ""
    if kind == "image":
        return node.attrs.get("alt", "")
    return node.attrs.get("value", "") or node.attrs.get("placeholder", "")


def render(node: Node, w: Writer, ordered: list | None = None) -> None:
    """Write the visible text of a node's children."""
    for c in node.children:
        if isinstance(c, str):
            if node.visible:
                w.text(c)
            continue
        if is_hidden(c):
            continue
        name = c.name
        if name == "br":
            if w.line:
                w.flush()
            else:
                w.gap = min(2, w.gap + 1)
        elif name == "hr":
            w.block(2)
        elif name == "img":
            w.text(c.attrs.get("alt", "") if c.visible else "")
        elif name == "input" or (name == "textarea" and not "".join(x for x in c.children if isinstance(x, str)).strip()):
            w.text(field_text(c) if c.visible else "")
        elif name in ("pre", "xmp", "plaintext", "listing"):
            w.block(2)
            for i, line in enumerate(raw_text(c).strip("\n").split("\n")):
                if line.strip():
                    w.put(line.rstrip())
                elif i:
                    w.gap += 1
            w.block(2)
        elif name == "table":
            w.block(2)
            render_table(c, w)
            w.block(2)
        elif name in ("ul", "ol", "menu", "dir"):
            nested = bool(w.indent)
            w.block(1 if nested else 2)
            start = c.attrs.get("start", "1").strip()
            render(c, w, [int(start[:6]) if start.isascii() and start.isdigit() else 1] if name == "ol" else None)
            w.block(1 if nested else 2)
        elif name == "li":
            w.block(1)
            marker = "- "
            if ordered:
                marker = f"{ordered[0]}. "
                ordered[0] += 1
            w.indent, before = w.indent + " " * len(marker), w.indent
            w.marker = marker
            render(c, w)
            w.flush()
            w.indent, w.marker = before, ""
            w.block(1)
        elif is_block(c):
            gap = 2 if name in SPACED else 1
            w.block(gap)
            if name in ("blockquote", "dd"):
                w.indent += "  "
                render(c, w)
                w.flush()
                w.indent = w.indent[:-2]
            else:
                render(c, w, ordered)
            w.block(gap)
        else:
            render(c, w, ordered)


def raw_text(node: Node) -> str:
    return "".join((c if node.visible else "") if isinstance(c, str) else "" if is_hidden(c) else "\n" if c.name == "br" else raw_text(c) for c in node.children)


def to_text(html: str | None) -> str | None:
    if html is None:
        return None
    w, root = Writer(), parse(html)
    apply_styles(root)
    render(root, w)
    w.flush()
    return "".join(w.out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 200):
                some = part.iloc[i : i + 200]
                yield pd.DataFrame({"page_id": some["page_id"], "url": some["url"], "text": [to_text(h if isinstance(h, str) else None) for h in some["html"].tolist()]})

    kind = pages.schema["page_id"].dataType
    found = pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(run, "page_id string, url string, text string")
    return found.withColumn("page_id", F.col("page_id").cast(kind))  # a null among numbers would make pandas round them
