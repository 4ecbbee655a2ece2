"""Layout-aware HTML rendering: all visible text, laid out as a page would lay it out.

Method: a tolerant tokenizer and a tree builder with implied end tags (paragraphs, list and
definition items, table parts, options) make a tree of any input; visibility rules prune it (elements
that are never rendered, ``hidden``, hidden inputs, closed dialogs, ``display`` and ``visibility`` of
style attributes and of the page's own style rules by element, class and id); a renderer then writes
blocks with their spacing, lists with indented bullets or numbers, preformatted text as it is, and
tables as aligned columns, cells that span rows and columns at their place.

Scale: one map over whole pages; nothing is shuffled.  Neither tree builder nor renderer recurses, so
elements nest to any depth by the same rules.  Time is linear in the page, as every open element's
place is known by its name.  A cell that others follow wraps at ``MAX_COLUMN`` characters between words,
so that columns align whatever they hold and one long cell cannot blow up the other rows.

Defined cases: null or empty pages give an empty text; input cut off inside a tag or comment ends
there; unknown elements are inline; a word longer than a column stays whole and moves what follows on
its line; ``visibility: visible`` inside a hidden element shows again, ``display: none`` hides for good;
style rules with combinators, pseudo-classes or inside at-rules are not applied; drawings and formulas
give their text, without titles, descriptions, definitions and annotations; repeated rows are rendered
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

MAX_COLUMN, MAX_SPAN = 60, 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
NEVER = frozenset(
    "script style head title template noscript iframe noembed noframes datalist object embed audio video canvas "
    "meta link base param source track area col colgroup rp".split()
)
#: Inside drawings and formulas these are for other readers than eyes.
_FOREIGN, _UNSEEN = ("svg", "math"), frozenset("desc metadata defs symbol annotation annotation-xml".split())
#: Blocks and the blank lines around them.
BLOCKS = dict.fromkeys(
    "address article aside body caption center details dialog dd div dl dt fieldset figcaption footer form frameset header "
    "hgroup html legend li main nav option search section select summary tbody tfoot thead tr".split(), 0
) | dict.fromkeys("blockquote figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split(), 1)
#: Starting one of the first closes an open one of the second, unless one of the third is nearer.
_CELLS, _PARTS, _ITEMS = {"td", "th"}, {"thead", "tbody", "tfoot"}, {"ul", "ol", "menu"}
_CLOSES_P = frozenset(set(BLOCKS) - {"body", "html", "option", "select", "tbody", "tfoot", "thead", "tr", "caption"})
IMPLIED = (
    ({"li"}, {"li"}, _ITEMS),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    (_CELLS, _CELLS, {"tr", "table"}),
    ({"tr"}, {"tr"} | _CELLS | {"caption"}, {"table"}),
    (_PARTS, _PARTS | {"tr", "caption"} | _CELLS, {"table"}),
    ({"option", "optgroup"}, {"option"}, {"select", "datalist"}),
    ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, set(BLOCKS) - {"p"}),
    ({"body"}, {"head"}, set()),
)
#: An end tag never reaches past these for an element outside them.
_WALLS = {"table": set(), "td": {"table", "tr"} | _PARTS, "th": {"table", "tr"} | _PARTS}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|$)|<[!?/][^>]*(?:>|$)", re.S)
#: A tag whose quotes never close ends at the next ">" after all, so that no text is lost with it.
_UNQUOTED = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|$)")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)$", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        found.setdefault(name.lower(), unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return found


class _Open:
    """The open elements, and at which depths each name stands."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.depths[node.name].append(len(self.stack))
        self.stack.append(node)

    def last(self, names) -> int:
        return max((held[-1] for n in names if (held := self.depths.get(n))), default=0)

    def close(self, names, walls) -> bool:
        """Closes the nearest of ``names`` and what is in it, unless one of ``walls`` is nearer."""
        at = self.last(names)
        if not at or self.last(walls) > at:
            return False
        for node in self.stack[at:]:
            self.depths[node.name].pop()
        del self.stack[at:]
        return True


def parse(html: str) -> tuple[Node, list[str]]:
    """(the tree of any text, the contents of its style elements); names are lower-case and children are
    nodes or strings."""
    root, styles = Node("#root", {}), []
    opened, at, end = _Open(root), 0, len(html)
    while at < end:
        start = html.find("<", at)
        token = (_TOKEN.match(html, start) or _UNQUOTED.match(html, start)) if start >= 0 else None
        here = opened.stack[-1].children
        if start < 0 or token is None:
            stop = end if start < 0 else start + 1
            here.append(unescape(html[at:stop]))
            at = stop
            continue
        if start > at:
            here.append(unescape(html[at:start]))
        at = token.end()
        name = (token[2] or "").lower()
        if not name or not token[4]:
            continue  # a comment, a declaration, or a tag that the input cuts off
        if token[1]:
            if name not in {"html", "body"}:
                opened.close((name,), [w for w, reach in _WALLS.items() if name != w and name not in reach])
            continue
        if name in _CLOSES_P:
            opened.close(("p",), ("table", "td", "th", "caption", "button"))
        for starts, closed, walls in IMPLIED:
            if name in starts:
                while opened.close(closed, walls):
                    pass
        node = Node(name, _attributes(token[3]))
        if name in _UNSEEN and opened.last(_FOREIGN):
            node.attrs["#unseen"] = ""
        opened.stack[-1].children.append(node)
        foreign = opened.last(_FOREIGN) and token[3].rstrip().endswith("/")
        if name in VOID or foreign:
            continue
        if name in RAW:
            tail = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            content = html[at : tail.start() if tail else end]
            if name == "style":
                styles.append(content)
            node.children.append(unescape(content) if name in {"textarea", "title"} else content)
            at = tail.end() if tail else end
        else:
            opened.push(node)
    return root, styles


class Styles:
    """``display`` and ``visibility`` of elements: the page's rules, then style attributes; important ones
    first, then the more specific, then the later."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list] = {}
        order = 0
        for sheet in sheets:
            if "display" not in sheet.lower() and "visibility" not in sheet.lower():
                continue
            for selectors, body in _plain_rules(_COMMENT.sub("", sheet)):
                found = [(m[0].lower(), m[1].lower(), bool(m[2])) for m in _DECLARATION.findall(body)]
                for selector in selectors.split(",") if found else ():
                    match = _COMPOUND.match(selector.strip())
                    if not match or not selector.strip():
                        continue
                    tag = (match[1] or "*").lower()
                    marks = re.findall(r"[.#][\w-]+", match[2])
                    ids = frozenset(m[1:] for m in marks if m[0] == "#")
                    classes = frozenset(m[1:] for m in marks if m[0] == ".")
                    order += 1
                    weight = (len(ids), len(classes), int(tag != "*"), order)
                    key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag
                    self.rules.setdefault(key, []).append((tag, ids, classes, weight, found))

    def of(self, node: Node) -> tuple[bool, bool | None]:
        """(whether the element is displayed, whether it is visible; None: as around it)."""
        attrs, best = node.attrs, {}
        if self.rules:
            own, classes = attrs.get("id"), attrs.get("class", "").split()
            for key in {node.name, "*", f"#{own}", *(f".{c}" for c in classes)}:
                for tag, ids, marks, weight, found in self.rules.get(key, ()):
                    if tag in ("*", node.name) and ids <= {own} and marks <= set(classes):
                        for name, value, strong in found:
                            best[name] = max(best.get(name, ((-1,),)), ((int(strong), *weight), value))
        if "style" in attrs:
            for n, (name, value, strong) in enumerate(_DECLARATION.findall(attrs["style"])):
                rank = ((int(bool(strong)), 1 << 30, 0, 0, n), value.lower())
                best[name.lower()] = max(best.get(name.lower(), ((-1,),)), rank)
        display = best["display"][1] if "display" in best else None
        unseen = "hidden" in attrs or (node.name == "dialog" and "open" not in attrs)
        seen = {"hidden": False, "collapse": False, "visible": True}.get(best["visibility"][1]) if "visibility" in best else None
        return (not unseen if display is None else display != "none"), seen


def _plain_rules(sheet: str):
    """(selectors, body) of the rules that stand in no at-rule."""
    at, end = 0, len(sheet)
    while at < end:
        start = sheet.find("{", at)
        if start < 0:
            return
        head = sheet[at:start].rpartition(";")[2].strip()
        depth, stop = 1, start + 1
        if head.startswith("@"):
            while depth and stop < end:
                depth += (sheet[stop] == "{") - (sheet[stop] == "}")
                stop += 1
        else:
            close = sheet.find("}", start)
            stop = end if close < 0 else close + 1
            yield head, sheet[start + 1 : stop - 1 if close >= 0 else stop]
        at = stop


def displayed(node: Node, styles: Styles) -> tuple[bool, bool | None]:
    if node.name in NEVER or "#unseen" in node.attrs:
        return False, None
    if node.name == "input" and node.attrs.get("type", "").strip().lower() == "hidden":
        return False, None
    return styles.of(node) if styles.rules or "style" in node.attrs or "hidden" in node.attrs or node.name == "dialog" else (True, None)


class _Canvas:
    """Lines written so far, the open line, and what stands before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.space, self.gap, self.indent, self.bullet = False, 0, "", ""

    def write(self, text: str) -> None:
        if not text:
            return
        words = _SPACES.sub(" ", text)
        if words[0] == " ":
            self.space = True
        core = words.strip(" ")
        if core:
            if self.space and self.open:
                self.open.append(" ")
            self.open.append(core)
            self.space = words[-1] == " "

    def end_line(self, keep_empty: bool = False) -> None:
        text = "".join(self.open)
        if text or keep_empty:
            if self.lines and text:
                self.lines += [""] * self.gap
            before = self.indent
            if self.bullet and text:
                before = self.indent[: len(self.indent) - len(self.bullet)] + self.bullet
                self.bullet = ""
            self.lines.append((before + text).rstrip(" ") if text else "")
            if text:
                self.gap = 0
        self.open, self.space = [], False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.open = [line]
            self.end_line(keep_empty=True)


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*[+-]?\d{1,9}", text or "")
    return int(found[0]) if found else default


def _wrapped(lines: list[str]) -> list[str]:
    """``lines`` broken between words where they are longer than a column."""
    out = []
    for line in lines:
        while len(line) > MAX_COLUMN:
            cut = line.rfind(" ", 1, MAX_COLUMN + 1)
            cut = cut if cut > 0 and line[:cut].strip() else line.find(" ", MAX_COLUMN)
            if cut < 0:
                break
            out.append(line[:cut])
            line = line[cut + 1 :]
        out.append(line)
    return out


class _Renderer:
    """Writes a tree to canvases.  Its methods are generators that yield the calls they need, which
    ``run`` works off on a stack of its own, so depth costs no recursion."""

    def __init__(self, styles: Styles):
        self.styles = styles

    def run(self, call) -> None:
        stack = [call]
        while stack:
            inner = next(stack[-1], None)
            if inner is None:
                stack.pop()
            else:
                stack.append(inner)

    def _rows(self, table: Node, seen: bool) -> tuple[list, list[list[tuple[Node, bool]]]]:
        """(captions and other content, rows of cells) of a table, each with its visibility, in order."""
        other, rows, waiting = [], [], [(table, seen)]
        for node, seen in waiting:
            for child in node.children:
                if isinstance(child, str):
                    if child.strip():
                        other.append((child, seen))
                    continue
                if child.name not in _PARTS and child.name != "tr" and child.name not in _CELLS:
                    other.append((child, seen))
                    continue
                shown, own = displayed(child, self.styles)
                if not shown:
                    continue
                own = seen if own is None else own
                if child.name in _PARTS:
                    waiting.append((child, own))
                elif child.name in _CELLS:
                    rows.append([(child, own)])
                else:
                    cells = []
                    for cell in child.children:
                        if isinstance(cell, str) or cell.name not in _CELLS:
                            if not isinstance(cell, str) or cell.strip():
                                other.append((cell, own))
                        else:
                            visible, mine = displayed(cell, self.styles)
                            if visible:
                                cells.append((cell, own if mine is None else mine))
                    rows.append(cells)
        return other, rows

    def table(self, node: Node, canvas: _Canvas, seen: bool):
        other, rows = self._rows(node, seen)
        for child, shown in other:
            if not isinstance(child, str):
                yield self.element(child, canvas, False, shown)
            elif shown:
                canvas.write(child)
        canvas.end_line()
        drawn, taken = [], {}  # taken: column -> rows that a cell above still reaches over
        for row in rows:
            cells, column = [], 0
            below: dict[int, int] = {}
            for cell, shown in row:
                while taken.get(column):
                    column += 1
                inner = _Canvas()
                for child in cell.children:
                    if not isinstance(child, str):
                        yield self.element(child, inner, False, shown)
                    elif shown:
                        inner.write(child)
                inner.end_line()
                span = min(MAX_SPAN, max(1, _number(cell.attrs.get("colspan"), 1)))
                high = _number(cell.attrs.get("rowspan"), 1)
                high = len(rows) if high == 0 else max(1, high)  # nought: to the end
                cells.append((column, span, inner.lines))
                for k in range(column, column + span):
                    if high > 1:
                        below[k] = high - 1
                column += span
            taken = {k: n - 1 for k, n in taken.items() if n > 1} | below
            drawn.append(cells)
        last = max((c + s for cells in drawn for c, s, _ in cells), default=0)
        drawn = [[(c, s, _wrapped(x) if c + s < last else x) for c, s, x in cells] for cells in drawn]
        widths: dict[int, int] = {}
        for cells in drawn:
            for column, span, lines in cells:
                if span == 1:
                    wide = max((len(x) for x in lines if column + 1 >= last or len(x) <= MAX_COLUMN), default=0)
                    widths[column] = max(widths.get(column, 0), wide)
        starts, at = {}, 0
        for column in range(last):
            starts[column] = at
            if widths.get(column):
                at += widths[column] + 2
        for cells in drawn:
            for n in range(max((len(lines) for *_, lines in cells), default=0)):
                line = ""
                for column, _, lines in cells:
                    text = lines[n] if n < len(lines) else ""
                    if text:
                        line = line.ljust(starts[column]) if len(line) <= starts[column] else line
                        line += ("  " if line and not line.endswith("  ") else "") + text
                canvas.add([line])

    def element(self, node: Node, canvas: _Canvas, pre: bool, seen: bool):
        shown, own = displayed(node, self.styles)
        if not shown:
            return
        seen = seen if own is None else own
        name = node.name
        if name == "br":
            canvas.end_line(keep_empty=True)
            return
        if name == "table":
            canvas.block(1)
            yield self.table(node, canvas, seen)
            canvas.block(1)
            return
        if name == "input" or name == "img":
            return
        gap = BLOCKS.get(name)
        if gap is not None:
            canvas.block(gap)
        elif name == "text":  # a label of a drawing stands by itself
            canvas.space = True
        pre = pre or name in {"pre", "textarea", "listing"}
        indent, bullet = canvas.indent, canvas.bullet
        if name in {"blockquote", "dd"}:
            canvas.indent += "    "
        counter = _number(node.attrs.get("start"), 1) if name == "ol" else None
        if name in _ITEMS:
            canvas.gap = 0 if indent else canvas.gap
        for child in node.children:
            if isinstance(child, str):
                if not seen:
                    continue
                if pre:
                    head, *tail = child.replace("\r\n", "\n").split("\n")
                    canvas.open.append(head)
                    for line in tail:
                        canvas.end_line(keep_empty=True)
                        canvas.open.append(line)
                elif name not in _ITEMS or child.strip():
                    canvas.write(child)
            elif child.name == "li" and displayed(child, self.styles)[0]:
                if counter is None:
                    mark = "* "
                else:
                    counter = _number(child.attrs.get("value"), counter)
                    mark, counter = f"{counter}. ", counter + 1
                canvas.end_line()
                canvas.indent, canvas.bullet = indent + "  " + " " * len(mark), mark
                yield self.element(child, canvas, pre, seen)
                canvas.end_line()
                canvas.indent, canvas.bullet = indent, bullet
            else:
                yield self.element(child, canvas, pre, seen)
        if gap is not None:
            canvas.block(gap if not (name in _ITEMS and indent) else 0)
        elif name == "text":
            canvas.space = True
        canvas.indent = indent


def render(html: str | None) -> str:
    """The visible text of one page."""
    if not isinstance(html, str) or not html:
        return ""
    canvas = _Canvas()
    tree, sheets = parse(html)
    renderer = _Renderer(Styles(sheets))
    renderer.run(renderer.element(tree, canvas, False, True))
    canvas.end_line()
    lines = canvas.lines
    while lines and not lines[-1].strip():
        lines.pop()
    first = next((n for n, x in enumerate(lines) if x.strip()), 0)
    return "\n".join(lines[first:]).replace("\xa0", " ")


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row."""

    @F.pandas_udf("string")
    def rendered(html: pd.Series) -> pd.Series:
        return pd.Series([render(h) for h in html], dtype=object)

    return pages.select(col(id_col).alias("page_id"), rendered(col(html_col)).alias("text"))
