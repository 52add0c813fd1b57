"""HTML to text by layout: a tree with implied tags, visibility rules, then block-wise rendering.

A tokeniser cuts tags, comments and text; the tree builder closes what HTML lets authors leave open (a new
``p``, ``li``, ``tr``, ``td``, ``option``, ... or a block inside ``p``) and ignores stray end tags. Elements
that browsers don't show are dropped with all they hold. Rendering walks the tree without recursion: inline
text flows together with white space collapsed, blocks start on new lines, paragraphs and headings are set
off by a blank line, list items get a bullet or number and indentation. An element's own style, or a rule of a style sheet
before it in the page, may hide it or make it a block or inline: rules of simple selectors (a name, classes and an id) for all
media, the more specific and later ones first; other selectors and rules under conditions are left out, so that text stays. Form controls stand apart by a space; of ``details`` that isn't open only the summary shows.

Tables are laid out from the inside out, as a grid with ``colspan`` and ``rowspan``: a row has as many lines as its
tallest cell, and the lines of all its cells (of blocks, lists and inner tables too) begin at their columns. A cell over
several rows goes on beside them. Lines beyond ``WIDEST`` run over their column and don't widen it, so that one long
paragraph doesn't push a whole table aside. Rows with a blank line in a cell are set off by blank lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, steps, table

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head title script style template noscript noembed noframes iframe object audio video canvas datalist area base col colgroup link meta param source track".split())
#: Not shown inside svg and math, where other text is.
FOREIGN_UNSEEN = {"svg": set("defs desc symbol metadata clippath mask marker pattern".split()), "math": {"annotation", "annotation-xml"}}
SET_OFF = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SET_OFF | set("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
#: A start tag closes an open element of these names, looked for no further out than the second list.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
#: End tags don't reach beyond these.
SCOPE = {"table", "td", "th", "html", "caption"}
TABLE_PARTS, TABLE_SCOPE = set("table caption tbody thead tfoot tr td th".split()), {"table", "html"}
#: Controls that stand apart from the text around them.
CONTROLS = set("button input meter output progress select textarea".split())
#: Whether an element of these values of display begins a line of its own. Lists' items and parts of tables keep theirs.
DISPLAY = dict.fromkeys("block flex grid flow-root list-item table".split(), True) | dict.fromkeys("inline inline-block inline-flex inline-grid contents initial unset".split(), False)
DISPLAY_FIXED = TABLE_PARTS | set("br hr pre colgroup col".split())
#: Widest line that widens its column, and the furthest place to which a line is filled up with blanks.
WIDEST, FURTHEST = 200, 2000
#: Most columns and rows that a cell spans by the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
#: Whole declarations of a style; comments are cut first.
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Rules of a style sheet: what begins with @ is cut first, with its braces.
AT_RULE = re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]++|\{[^{}]*+\}?)*+\}?|\Z)")
RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}?")
SELECTOR = re.compile(r"\s*([a-zA-Z][a-zA-Z0-9]*|\*)?((?:[.#][\w-]+)*)\s*")
NUMBER = re.compile(r"\s*-?[0-9]{1,6}\s*")
WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; ``inside`` holds elements and strings in order."""

    __slots__ = ("name", "inside", "seen", "shown", "start", "step", "span", "rows", "lines", "block", "closed")

    def __init__(self, name: str, seen: bool = True):
        self.name, self.inside, self.seen = name, [], seen
        self.start, self.step = None, 1  # number of a list's first item, or of an item
        self.span, self.rows = 1, 1
        self.lines: list[str] = []  # of a table, once laid out
        self.shown: bool | None = None  # visibility set here; None: inherited
        self.block = name in BLOCK
        self.closed = name == "details"  # all but its summary is folded away


#: Rules by one of the things that their selector asks for: all of these, then rank and value of each property.
Rules = dict[str, dict[frozenset, dict[str, tuple[tuple, str]]]]
_LEAST: tuple[tuple, str] = ((False, -1), "")


def _style(text: str) -> dict[str, tuple[bool, str]]:
    """Whether important, and value, of display and visibility: the last declaration of each, important ones first."""
    found: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARATION.findall(STYLE_COMMENT.sub("", text)):
        if name.lower() not in found or important or not found[name.lower()][0]:
            found[name.lower()] = (bool(important), value.lower())
    return found


def _sheet(text: str, rules: Rules, place: int) -> None:
    """Add the rules of a style sheet, at a ``place`` of the page, that speak of display or visibility."""
    for rule in RULE.finditer(AT_RULE.sub("", STYLE_COMMENT.sub("", text).replace("<!--", "").replace("-->", ""))):
        style = _style(rule[2])
        for selector in rule[1].split(",") if style else ():
            m = SELECTOR.fullmatch(selector)
            if m and (m[1] or m[2]):
                name = (m[1] or "*").lower()
                parts = re.findall(r"[.#][\w-]+", m[2])
                asked = frozenset([name, *parts])
                ids = [x for x in parts if x[0] == "#"]
                keys = ids or parts or [name]
                key = next((k for k in keys if asked in rules.get(k, ())), min(keys, key=lambda k: len(rules.get(k, ()))))
                kept = rules.setdefault(key, {}).setdefault(asked, {})
                for k, (important, value) in style.items():
                    rank = (important, 0, len(ids), len(parts) - len(ids), name != "*", place + rule.start())
                    kept[k] = max(kept.get(k, _LEAST), (rank, value))


def _cascade(name: str, found: dict[str, str], rules: Rules) -> dict[str, str]:
    """Values of display and visibility of an element, from its own style and from rules."""
    own = _style(html.unescape(found["style"])) if found.get("style") else {}
    best = {k: ((important, 1), value) for k, (important, value) in own.items()}
    if rules:
        has = {name, "*", *("." + c for c in (found.get("class") or "").split()), *(["#" + found["id"]] if found.get("id") else [])}
        for key in has:
            for asked, kept in rules.get(key, {}).items():
                if asked <= has:
                    for k, ranked in kept.items():
                        best[k] = max(best.get(k, _LEAST), ranked)
    return {k: value for k, (_, value) in best.items()}


def _element(name: str, attributes: str, rules: Rules) -> Node:
    node = Node(name, name not in UNSEEN)
    if rules or attributes and not attributes.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}
        style = _cascade(name, found, rules)
        if "visibility" in style:
            node.shown = {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(style["visibility"])
        if "hidden" in found or style.get("display") == "none" or name == "input" or (name == "dialog" and "open" not in found):
            node.seen = False
        if style.get("display") in DISPLAY and name not in DISPLAY_FIXED:
            node.block = DISPLAY[style["display"]]
        if "open" in found:
            node.closed = False
        number = lambda k, default: int(found[k]) if NUMBER.fullmatch(found.get(k) or "") else default
        node.start = number("value" if name == "li" else "start", None)
        node.step = -1 if name == "ol" and "reversed" in found else 1
        node.span, node.rows = max(1, min(number("colspan", 1), MOST_COLUMNS)), max(1, min(number("rowspan", 1), MOST_ROWS))
    elif name in ("input", "dialog"):
        node.seen = False
    return node


def parse(source: str) -> Node:
    """Tree of a whole page; any text gives a tree."""
    root = Node("#root")
    open_ = [root]
    shown = [True]  # whether text in each open element is visible
    rules: Rules = {}
    counts: Counter[str] = Counter()  # of open elements by name, so that deep pages aren't searched in vain

    def push(node: Node) -> None:
        open_.append(node)
        shown.append(shown[-1] if node.shown is None else node.shown)
        counts[node.name] += 1

    def close(names: set[str], stop: set[str]) -> None:
        if not any(counts[name] for name in names):
            return
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].name in names:
                counts.subtract(n.name for n in open_[i:])
                del open_[i:], shown[i:]
                return
            if open_[i].name in stop:
                return

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if shown[-1] and (text[0] != "<" or text == "<"):
                open_[-1].inside.append(html.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m[1]:
            if name == "p" and not counts["p"]:
                open_[-1].inside.append(Node("p"))
            elif name == "br":
                open_[-1].inside.append(Node("br"))
            else:
                close({name}, (TABLE_SCOPE if name in TABLE_PARTS else SCOPE) - {name})
            continue
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
        if name in BLOCK and name not in ("html", "body"):
            close({"p"}, SCOPE | {"button", "object"})
            if name[0] == "h" and len(name) == 2 and open_[-1].name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                counts[open_.pop().name] -= 1
                shown.pop()
        elif name == "a":
            close({"a"}, SCOPE)
        if name == "body":
            close({"head"}, {"body"})
        # rows and cells without the elements around them
        if name == "tr" and open_[-1].name == "table":
            open_[-1].inside.append(Node("tbody"))
            push(open_[-1].inside[-1])
        elif name in ("td", "th") and open_[-1].name in ("table", "tbody", "thead", "tfoot"):
            for between in ("tbody", "tr") if open_[-1].name == "table" else ("tr",):
                open_[-1].inside.append(Node(between))
                push(open_[-1].inside[-1])
        attributes = m[3]
        node = _element(name, attributes, rules)
        for outer, unseen in FOREIGN_UNSEEN.items():
            if counts[outer] and name in unseen:
                node.seen = False
        if name == "text" and counts["svg"]:  # placed apart from the text before
            open_[-1].inside.append(" ")
        open_[-1].inside.append(node)
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])|\\Z", re.I).search(source, at)
            text = source[at : stop.start()]
            if shown[-1] if node.shown is None else node.shown:
                node.inside.append(html.unescape(text) if name in ("textarea", "title") else text)
            if name == "style" and "media" not in attributes.lower():
                _sheet(text, rules, at)
            tail = source.find(">", stop.end())
            at = end if tail < 0 else tail + 1
        elif name not in VOID and not attributes.endswith("/") or name in BLOCK - {"hr"}:
            push(node)
    return root


class _Lines:
    """Finished lines and the line in progress; blank lines are kept back until text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = 0
        self.prefix = ""
        self.mark = ""

    def text(self, words: str) -> None:
        text = WHITE.sub(" ", words)
        if text == " " and (not self.now or self.now[-1].endswith(" ")):
            return
        if not self.now or self.now[-1].endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            self.now.append(text)

    def end(self, blank: int = 0) -> None:
        line = "".join(self.now).strip(" ")
        self.now = []
        if line:
            self.put(line)
        self.blank = max(self.blank, blank)

    def put(self, line: str) -> None:
        if self.lines and self.blank:
            self.lines.append("")
        self.blank = 0
        first = self.prefix[: len(self.prefix) - len(self.mark)] + self.mark if self.mark else self.prefix
        self.lines.append((first + line).rstrip())
        self.mark = ""


def render(root: Node) -> str:
    """Visible text of a tree."""
    tables, work = [], [root]
    while work:
        node = work.pop()
        if not isinstance(node, str) and node.seen:
            if node.name == "table":
                tables.append(node)
            work.extend(node.inside)
    for node in reversed(tables):  # inner ones come later
        node.lines = list(_table(node))
    return "\n".join(_rendered(root))


def _rendered(root: Node) -> list[str]:
    """Lines of a tree whose tables are laid out."""
    out = _Lines()
    # work: (element, step); step 0 opens it, 1 closes it. lists: [kind, next number, prefix before, step]
    work: list = [(root, 0)]
    lists: list[list] = []
    pre = 0
    while work:
        node, step = work.pop()
        if isinstance(node, str):
            if pre:
                first, *more = node.replace("\r\n", "\n").split("\n")
                out.now.append(first)
                for line in more:
                    out.put("".join(out.now)) if "".join(out.now).strip() else out.end(1)
                    out.now = [line]
            else:
                out.text(node)
            continue
        name = node.name
        if step == 0:
            if not node.seen:
                continue
            if name == "br":
                line = out.now
                out.end(0 if line else 1)
                continue
            if name == "table":
                out.end(1)
                for line in node.lines:
                    out.put(line) if line else out.end(1)
                out.end(1)
                continue
            if node.block:
                out.end(name in SET_OFF and not (name in ("ul", "ol") and lists))
            elif name in CONTROLS:
                out.text(" ")
            if name in ("ul", "ol", "menu", "dir"):
                start = sum(not isinstance(x, str) and x.name == "li" for x in node.inside) if node.step < 0 else 1
                lists.append(["ol" if name == "ol" else "ul", start if node.start is None else node.start, out.prefix, node.step])
            elif name == "li" and node.block:
                if lists and node.start is not None:
                    lists[-1][1] = node.start
                kind, number, before, step = lists[-1] if lists else ["ul", 1, out.prefix, 1]
                out.mark = f"{number}. " if kind == "ol" else "- "
                out.prefix = before + " " * len(out.mark)
                if lists:
                    lists[-1][1] += step
            elif name in ("dd", "blockquote"):
                out.prefix += "  "
            elif name == "pre":
                pre += 1
            work.append((node, 1))
            inside = node.inside
            if node.closed:
                inside = [x for x in inside if not isinstance(x, str) and x.name == "summary"][:1]
            work.extend((x, 0) for x in reversed(inside))
            continue
        if name == "pre":
            pre -= 1
        if name in CONTROLS and not node.block:
            out.text(" ")
        if node.block:
            if name == "pre" and "".join(out.now).strip():
                out.put("".join(out.now).rstrip())
                out.now = []
            out.end(name in SET_OFF and not (name in ("ul", "ol") and len(lists) > 1))
        if name in ("ul", "ol", "menu", "dir"):
            out.prefix = lists.pop()[2]
        elif name == "li" and node.block:
            out.prefix = lists[-1][2] if lists else out.prefix[:-2]
            out.mark = ""
        elif name in ("dd", "blockquote"):
            out.prefix = out.prefix[:-2]
    out.end()
    return out.lines


def _cells(node: Node) -> tuple[list[list[Node]], list]:
    """Rows of cells of a table, and what stands outside of them (captions, stray text), in order."""
    rows, loose, work = [], [], [(x, None) for x in reversed(node.inside)]
    while work:
        part, row = work.pop()
        if isinstance(part, str):
            loose.append(part)
        elif not part.seen:
            continue
        elif part.name == "tr":
            rows.append([])
            work.extend((x, rows[-1]) for x in reversed(part.inside))
        elif part.name in ("td", "th"):
            if row is None:
                rows.append(row := [])
            row.append(part)
        elif part.name in ("tbody", "thead", "tfoot"):
            work.extend((x, None) for x in reversed(part.inside))
        else:
            loose.append(part)
    return rows, loose


def _alone(inside: list) -> list[str]:
    part = Node("#part")
    part.inside = inside
    return _rendered(part)


def _table(node: Node) -> Iterator[str]:
    """Lines of a table whose inner tables are laid out. Captions and stray text come first."""
    rows, loose = _cells(node)
    yield from _alone(loose)
    laid: list[list[tuple[int, int, list[str]]]] = []  # (column, rows spanned, lines) of each row's cells
    taken: dict[int, int] = {}  # rows from here that a cell above still covers, by column
    needs: dict[int, list[tuple[int, int]]] = {}  # (column, width) of the cells that end before a column
    for row in rows:
        cells, at, begun = [], 0, {}
        for cell in row:
            while at in taken:
                at += 1
            lines = _alone(cell.inside)
            cells.append((at, cell.rows, lines))
            if cell.rows > 1:
                begun |= dict.fromkeys(range(at, at + cell.span), cell.rows)
            needs.setdefault(at, [])
            needs.setdefault(at + cell.span, []).append((at, max((len(line) for line in lines if len(line) <= WIDEST), default=0)))
            at += cell.span
        laid.append(cells)
        taken = {c: n - 1 for c, n in (taken | begun).items() if n > 1}
    starts: dict[int, int] = {}
    start = 0
    for column in sorted(needs):  # each as far left as the cells before it let it be
        start = max([start, *(starts[at] + width + 2 for at, width in needs[column])])
        starts[column] = start
    going: list[tuple[int, int, list[str]]] = []  # cells from rows above: column, rows left, lines left
    set_off = False
    for k, cells in enumerate(laid):
        last = k == len(laid) - 1
        parts = sorted(going + cells, key=lambda cell: cell[0])
        height = max((len(lines) if last or left == 1 else min(len(lines), 1) for _, left, lines in parts), default=0)
        spaced = any("" in lines[:height] for _, _, lines in parts)
        if spaced or set_off:
            yield ""
        set_off = spaced
        for i in range(height):
            line = ""
            for at, _, lines in parts:
                if i < len(lines) and lines[i]:
                    start = min(starts[at], FURTHEST)
                    line = line.ljust(max(start, len(line) + 2 * bool(line))) + lines[i]
            yield line
        going = [(at, left - 1, lines[height:]) for at, left, lines in parts if left > 1 and len(lines) > height]


def extract(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the markup column, and with ``text``: the visible text of each whole page.

    A null page has null text, an empty one (or one that shows nothing) an empty text. Malformed markup
    never fails: what isn't a tag is text. Repeated rows each return a row; a column ``text`` of the input
    is replaced.
    """
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_column, "text")]
    narrow = pages.select(*kept, F.col(html_column).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__html"):
            texts = [extract(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, schema + "text string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
