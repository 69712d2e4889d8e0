"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (an open paragraph ends before a block, a list item
before the next, a cell before the next cell, and so on) make a tree; a renderer walks it with
visibility rules and emits all visible text: blocks on lines of their own, a blank line around
paragraphs and headings, list items with bullets or numbers and indentation, table rows on lines
with aligned cells, preformatted text as it is.

Not visible: what stands in elements that browsers never show (head, script, style, template, ...),
elements with the attribute hidden, or with display:none or visibility:hidden in their style
attribute or by a style-sheet rule for one tag, class or id, and closed dialogs.

Defined results: null and empty pages give the empty text; ill-formed markup is read leniently,
never refused; nesting is as deep as the page's (no recursion); equal pages give equal texts.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
UNSEEN = frozenset("head script style template title noscript iframe object audio video canvas svg datalist noembed noframes meta link base area param rp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul h1 h2 h3 h4 h5 h6 table caption tr thead tbody tfoot td th colgroup".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag ends the open elements in the first set, up to the nearest one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html body button".split())

_token = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_attribute = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_space = re.compile(r"[ \t\r\n\f]+")
_rule = re.compile(r"([^{}]+)\{([^{}]*)\}")
_hides = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I).search


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _attribute.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> tuple[Node, list[str]]:
    """The page's tree and the texts of its style elements."""
    root = Node("#root", {})
    stack, styles, at, size = [root], [], 0, len(page)
    while at < size:
        m = _token.search(page, at)
        if m is None or m.start() > at:
            end = m.start() if m else size
            stack[-1].children.append(html.unescape(page[at:end]))
            at = end
            if m is None:
                break
        at = max(m.end(), at + 1)
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            _end(stack, tag)
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, SCOPE)
        if tag in IMPLIED:
            _close(stack, *IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            _push(stack, Node("tr", {}))
        node = Node(tag, attributes_of(m[3]) if m[3].strip(" /") else {})
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in ESCAPABLE:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : close.start() if close else size]
            node.children.append(html.unescape(inside) if tag in ESCAPABLE else inside)
            if tag == "style":
                styles.append(inside)
            at = close.end() if close else size
            continue
        stack.append(node)
    return root, styles


def _push(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    stack.append(node)


def _close(stack: list[Node], tags, until) -> None:
    """End the outermost open element of tags that lies within the nearest element of until."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in until:
            break
        if stack[k].tag in tags:
            lowest = k
            while lowest > 1 and stack[lowest - 1].tag in tags:
                lowest -= 1
            del stack[lowest:]
            if not stack[-1].tag in tags:
                return _close(stack, tags, until)


def _end(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
            break
    if tag == "p":
        stack[-1].children.append(Node("p", {}))


def hidden_by(styles: list[str]) -> frozenset[str]:
    """Selectors of one tag, .class or #id that style sheets hide."""
    found = set()
    for sheet in styles:
        for m in _rule.finditer(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if _hides(m[2]):
                found |= {s.strip() for s in m[1].split(",") if re.fullmatch(r"[.#]?[\w-]+", s.strip())}
    return frozenset(found)


def visible(node: Node, hidden: frozenset[str]) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if a.get("style") and _hides(a["style"]):
        return False
    if hidden and (node.tag in hidden or "#" + a.get("id", "") in hidden or any("." + c in hidden for c in a.get("class", "").split())):
        return False
    return True


def width(text: str) -> int:
    """Columns of a text: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Collects inline text into lines; blocks break lines, spaced blocks leave one blank line."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.indent = ""
        self.bullet = ""

    def text(self, text: str, keep: bool) -> None:
        if not keep:
            text = _space.sub(" ", text)
            if text[:1] == " " and (not self.now or self.now[-1].endswith((" ", "\n"))):
                text = text[1:]
            if text:
                self.now.append(text)
            return
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self.now.append(first)
        for line in rest:
            self.line(True)
            if line:
                self.now.append(line)

    def line(self, always: bool = False) -> None:
        text = "".join(self.now)
        self.now = []
        if not always:
            text = text.strip(" ")
            if not text:
                return
        if self.blank and self.done and text:
            self.done.append("")
        if text:
            self.blank = False
        lead = self.indent[: len(self.indent) - len(self.bullet)] + self.bullet if self.bullet and text else self.indent
        if text:
            self.bullet = ""
        self.done.append((lead + text).rstrip() if text else "")

    def space(self) -> None:
        self.line()
        self.blank = True

    def result(self) -> str:
        self.line()
        return "\n".join(self.done).strip("\n")


def render(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    root, styles = parse(page)
    hidden = hidden_by(styles)
    # a frame: node, number of the next child, lines that it writes to, preformatted, state of a table or list
    lines = Lines()
    stack: list[list] = [[root, 0, lines, False, None]]
    while stack:
        frame = stack[-1]
        node, at, out, pre, state = frame
        if at >= len(node.children):
            stack.pop()
            _leave(node, out, state, stack)
            continue
        frame[1] += 1
        child = node.children[at]
        if isinstance(child, str):
            if node.tag not in ("table", "thead", "tbody", "tfoot", "tr") or child.strip():
                out.text(child, pre)
            continue
        if not visible(child, hidden):
            continue
        tag = child.tag
        if tag == "br":
            out.line(bool(out.now) or not out.blank)
            continue
        if tag == "img":
            if child.attributes.get("alt", "").strip():
                out.text(child.attributes["alt"], False)
            continue
        if tag == "hr":
            out.space()
            continue
        if tag == "input":
            shown = child.attributes.get("value") or child.attributes.get("placeholder") or ""
            if child.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "file", "image") and shown:
                out.text(" " + shown + " ", False)
            continue
        own_state, own_out = None, out
        if tag in BLOCK:
            out.space() if tag in SPACED and not (tag in ("ul", "ol", "dl") and _in_list(stack)) else out.line()
        if tag in ("ul", "ol", "menu", "dir", "dl"):
            own_state = {"kind": tag, "n": _start(child) - 1, "indent": out.indent}
            if _in_list(stack):
                own_state["nested"] = True
        elif tag == "li":
            holder = next((f[4] for f in reversed(stack) if f[4] and f[4].get("kind") in ("ul", "ol", "menu", "dir")), None)
            own_state = {"kind": "li", "indent": out.indent}
            if holder and holder["kind"] == "ol":
                holder["n"] += 1
                out.bullet = f"{holder['n']}. "
            else:
                out.bullet = "- "
            out.indent += " " * len(out.bullet)
        elif tag in ("dd", "blockquote"):
            own_state = {"kind": tag, "indent": out.indent}
            out.indent += "    "
        elif tag == "table":
            own_state = {"kind": "table", "rows": []}
        elif tag == "tr":
            table = next((f[4] for f in reversed(stack) if f[4] and f[4].get("kind") == "table"), None)
            if table is not None:
                table["rows"].append([])
        elif tag in ("td", "th"):
            table = next((f[4] for f in reversed(stack) if f[4] and f[4].get("kind") == "table"), None)
            if table is not None and table["rows"]:
                own_out = Lines()
                own_state = {"kind": "cell", "row": table["rows"][-1], "span": max(1, min(100, _int(child.attributes.get("colspan"), 1)))}
        stack.append([child, 0, own_out, pre or tag in ("pre", "textarea"), own_state])
    return lines.result()


def _in_list(stack: list[list]) -> bool:
    return any(f[4] and f[4].get("kind") == "li" for f in stack)


def _int(text: str | None, other: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text) else other


def _start(node: Node) -> int:
    return _int(node.attributes.get("start"), 1)


def _leave(node: Node, out: Lines, state: dict | None, stack: list[list]) -> None:
    tag = node.tag
    kind = state and state.get("kind")
    if kind == "cell":
        state["row"].append(out.result().split("\n"))
        state["row"].extend([[""]] * (state["span"] - 1))
        return
    if tag in BLOCK:
        out.line(tag == "pre" and bool(out.now))
    if kind == "table":
        for line in _aligned(state["rows"]):
            out.now.append(line)
            out.line(True)
        out.blank = True
    elif state and "indent" in state:
        out.indent = state["indent"]
        out.bullet = ""
    if tag in SPACED and not (state and state.get("nested")):
        out.blank = True


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Lines of a table: cells of a column start at one place, two spaces after the widest."""
    rows = [r for r in rows if any(any(x) for x in r)]
    columns = max(map(len, rows), default=0)
    widths = [max((width(line) for r in rows if k < len(r) for line in r[k]), default=0) for k in range(columns)]
    out = []
    for row in rows:
        for n in range(max(map(len, row))):
            parts = [(c[n] if n < len(c) else "") for c in row]
            out.append("  ".join(p + " " * (w - width(p)) for p, w in zip(parts, widths)).rstrip())
    return out


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and the visible text of each page."""

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), html_col).mapInArrow(apply, "page_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
