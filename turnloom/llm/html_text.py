"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout of blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.scratch import bounded

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
HIDDEN = frozenset("head title meta link base script style template iframe noframes object audio video canvas datalist area param".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
#: Blocks that stand apart from their neighbours by an empty line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote table figure hr fieldset".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt legend optgroup option summary".split()) | {"summary"}
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
CELLS = frozenset(("td", "th", "caption"))
#: A start tag closes open elements of these kinds, looking up to the nearest element that bounds it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "caption": ({"caption"}, {"table"}),
}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[{};]|(?:[^{};\"'/\\<-]|\\.)+|.", re.S)
_SPACE = re.compile(r"[ \t\n\f\r]+")


#: Elements of drawings and formulas that show nothing themselves, and those of drawings that hold HTML again.
FOREIGN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter script style".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: A start tag of these ends a drawing or formula that is still open.
LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(source: str) -> Node:
    """The tree of a page. Whatever is wrong or left out in the markup, each text has its place in it."""
    root = Node("#root")
    open_ = [root]
    n_open: Counter[str] = Counter()  # by tag, so that deep nesting isn't searched for what is not there

    edges: list[int] = []  # where drawings, formulas and HTML in them begin

    def pop_to(k: int) -> None:
        while edges and edges[-1] >= k:
            edges.pop()
        n_open.subtract(n.tag for n in open_[k:])
        del open_[k:]

    def close(kinds: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> bool:
        if not any(n_open[kind] for kind in kinds):
            return False
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in kinds:
                pop_to(k)
                return True
            if open_[k].tag in bounds:
                return False
        return False

    def foreign() -> int:
        """The place of the drawing or formula whose content comes next, 0 if that is HTML."""
        return edges[-1] if edges and open_[edges[-1]].tag in FOREIGN else 0

    def start(tag: str, attributes: dict[str, str]) -> None:
        if tag in LEAVES and (k := foreign()):
            pop_to(k)
        if tag in ENDS:
            kinds, bounds = ENDS[tag]
            while close(kinds, bounds):
                pass
        if tag in CLOSES_P:
            close({"p"}, CELLS | {"button", "table"})
        # Implied starts: cells need a row, and what isn't part of a table ends its head.
        if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
            start("tr", {})
        if tag not in HIDDEN | {"html", "head", "noscript"} and n_open["head"]:
            close({"head"}, frozenset())
        node = Node(tag, attributes)
        open_[-1].children.append(node)
        if tag not in VOID:
            if tag in FOREIGN or tag in POINTS:
                edges.append(len(open_))
            open_.append(node)
            n_open[tag] += 1

    def end(tag: str) -> None:
        if tag == "br":
            start("br", {})
        elif tag == "p" and not n_open["p"]:
            open_[-1].children.append(Node("p"))
        elif tag in ("html", "body") or tag in VOID:
            return  # what follows belongs to the body all the same
        elif re.fullmatch("h[1-6]", tag):
            close({"h1", "h2", "h3", "h4", "h5", "h6"}, CELLS | {"table"})
        else:
            close({tag}, frozenset() if tag in TABLE_PARTS | {"table"} else CELLS | {"table"})

    def text(raw: str, decode: bool = True) -> None:
        if raw:
            if n_open["head"] and open_[-1].tag in ("head", "html") and raw.strip():
                close({"head"}, frozenset())
            open_[-1].children.append(html.unescape(raw) if decode else raw)

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        text(source[at : m.start() if m else size])
        if not m:
            break
        token, at = m.group(), m.end()
        if token.startswith("<![CDATA["):
            text(token[9:].removesuffix("]]>"), decode=False)
        elif token[1] in "!?":
            continue
        else:
            tag = _NAME.match(token)[1].lower()
            if token[1] == "/":
                end(tag)
                continue
            body = token[1 + len(tag) :].rstrip(">").rstrip("/") if token.endswith("/>") else token[1 + len(tag) :].rstrip(">")
            attributes: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(body):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            start(tag, attributes)
            if token.endswith("/>") and open_[-1].tag == tag and foreign():
                pop_to(len(open_) - 1)
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                text(source[at : stop.start() if stop else size], decode=tag in ("title", "textarea"))
                pop_to(len(open_) - 1)
                at = size if not stop else source.find(">", stop.end()) + 1 or size
    return root


def hiding_rules(root: Node) -> dict[str, str]:
    """Selectors of one tag, .class or #id in the page's style elements that hide: {selector: "none" or "hidden"}."""
    out: dict[str, str] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            for selectors, body in style_rules("".join(c for c in node.children if isinstance(c, str))):
                if found := _hides(body):
                    out |= {s.strip(): found for s in selectors.split(",") if re.fullmatch(r"[.#]?[\w-]+", s.strip())}
        todo += [c for c in node.children if isinstance(c, Node)]
    return out


def style_rules(css: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on any screen; braces are matched.

    Whether a block with conditions holds depends on the reader's device, so that its rules hide nothing.
    """
    out: list[tuple[str, str]] = []
    head: list[str] = []
    selectors, blocks = "", []  # the open braces: "always", "rule" or "never"
    for m in _CSS.finditer(css):
        token, inner = m.group(), blocks[-1] if blocks else "always"
        if token.startswith("/*") or token in ("<!--", "-->"):
            continue
        if token == "{":
            name = "".join(head).strip()
            if inner == "always":
                blocks.append("rule" if not name.startswith("@") else "always" if _always(name) else "never")
                selectors, head = name, []
            else:
                blocks.append("never")
                if inner == "rule":  # what stands before a nested rule is no declaration
                    head = ["".join(head).rpartition(";")[0], ";"]
        elif token == "}":
            if inner == "rule":
                out.append((selectors, "".join(head)))
            if blocks:
                blocks.pop()
            if "rule" not in blocks:
                head = []
        elif token == ";" and inner == "always":
            head = []
        elif inner != "never":
            head.append(token)
    if "rule" in blocks:  # the end of a sheet closes what is open
        out.append((selectors, "".join(head)))
    return out


def _always(name: str) -> bool:
    kind, _, queries = re.sub(r"\s+", " ", name.lower()).partition(" ")
    return kind == "@layer" or kind == "@media" and any(q.strip().removeprefix("only ").strip() in ("", "all", "screen") for q in queries.split(","))


def _hides(style: str) -> str:
    style = re.sub(r"\s+", "", style.lower())
    if re.search(r"(^|;)display:none", style):
        return "none"
    if re.search(r"(^|;)visibility:(hidden|collapse)", style):
        return "hidden"
    return "visible" if re.search(r"(^|;)visibility:visible", style) else ""


def visibility(node: Node, rules: dict[str, str]) -> str:
    """"none": neither the element nor anything in it; "hidden" and "visible" hold until an inner element says otherwise."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"] != "until-found" or node.tag == "dialog" and "open" not in a:
        return "none"
    if own := _hides(a.get("style", "")):
        return own
    for selector in (f"#{a['id']}" if "id" in a else "", *(f".{c}" for c in a.get("class", "").split()), node.tag):
        if selector in rules:
            return rules[selector]
    return ""


def width(line: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Flow:
    """Lines of one block. Runs of white space are one space, and empty lines between blocks never add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, raw: str, pre: bool) -> None:
        if pre:
            first, *more = raw.replace("\r\n", "\n").split("\n")
            self.word((" " if self.space and self.line and first else "") + first)
            self.space = False
            for x in more:
                self.newline(force=True)
                self.word(x)
            return
        words = _SPACE.split(raw)
        for k, w in enumerate(words):
            if k:
                self.space = True
            if w:
                self.word((" " if self.space and self.line else "") + w)
                self.space = False

    def word(self, w: str) -> None:
        if w:
            if not self.line:
                self.open()
            self.line.append(w)

    def open(self) -> None:
        if self.lines and self.gap > 1:
            self.lines.append("")
        self.gap = 0

    def newline(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        """Ends the line; the next text stands on a line of its own, behind an empty one at a gap of 2."""
        self.newline()
        self.gap = max(self.gap, gap)

    def insert(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self.open()
            self.lines += lines
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Table rows of cells (lines, columns spanned) with columns padded to the widest cell, two spaces apart."""
    widths: list[int] = []
    for row in rows:
        column = 0
        for lines, span in row:
            widths += [0] * (column + span - len(widths))
            if span == 1:
                widths[column] = max([widths[column], *map(width, lines)])
            column += span
    for row in rows:  # a spanning cell widens the last column that it covers
        column = 0
        for lines, span in row:
            if span > 1 and lines:
                lack = max(map(width, lines)) - sum(widths[column : column + span]) - 2 * (span - 1)
                widths[column + span - 1] += max(0, lack)
            column += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            parts, column = [], 0
            for lines, span in row:
                cell = lines[k] if k < len(lines) else ""
                parts.append(cell + " " * (sum(widths[column : column + span]) + 2 * (span - 1) - width(cell)))
                column += span
            out.append("  ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """All visible text as lines. The tree is walked with a stack of its own, so nesting may be as deep as it likes."""
    rules = hiding_rules(root)
    flows, lists, tables = [Flow()], [], []
    # (node or text, visible, preformatted, "svg" or "math" or "text" of a drawing); a node comes back as ("end", ...) when it is done.
    todo: list[tuple] = [(c, True, False, "") for c in reversed(root.children)]
    while todo:
        what, visible, pre, inside = todo.pop()
        if isinstance(what, str):
            if visible and inside != "svg" and not (tables and tables[-1][1] is None and not what.strip()):
                flows[-1].text(what, pre)
            continue
        if isinstance(what, tuple):
            if what[1].tag != "text" or inside == "text":
                _leave(what[1], flows, lists, tables)
            continue
        tag = what.tag
        shown = visibility(what, rules)
        if shown == "none" or tag in FOREIGN["svg" if inside == "text" else inside or "svg"] and inside:
            continue
        visible = visible if not shown else shown == "visible"
        if tag in FOREIGN:
            inside = tag
        elif tag == "foreignobject":
            inside = ""
        elif tag == "text" and inside == "svg":  # each text of a drawing has a place of its own
            inside = "text"
            flows[-1].block(1)
        if tag == "br":
            flows[-1].newline(force=True)
            continue
        if tag == "wbr":
            continue
        _enter(what, flows, lists, tables)
        todo.append((("end", what), visible, pre, inside))
        children = what.children
        if tag == "option" and what.attributes.get("label"):
            children = [what.attributes["label"]]
        elif tag == "optgroup" and what.attributes.get("label"):
            children = [what.attributes["label"], *children]
        elif tag == "textarea":
            children = [re.sub(r"\A\r?\n", "", "".join(children))]
        if tag == "details" and "open" not in what.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        todo += [(c, visible, pre or tag in ("pre", "listing", "textarea"), inside) for c in reversed(children)]
    return "\n".join(flows[0].done())


def _number(value: str, otherwise: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,6})", value)
    return int(m[1]) if m else otherwise


def _enter(node: Node, flows: list[Flow], lists: list[list], tables: list[list]) -> None:
    tag = node.tag
    if tag == "table":
        flows[-1].block(2)
        tables.append([[], None])  # rows, cells of the open row
        flows.append(Flow())  # for text that stands between cells
    elif tag == "tr" and tables:
        tables[-1][1] = []
    elif tag in ("td", "th", "caption", "li", "blockquote", "dd"):
        flows.append(Flow())
        if tag == "li":
            if lists and lists[-1][0] == "ol":
                lists[-1][1] = _number(node.attributes.get("value", ""), lists[-1][1])
    elif tag in BLOCK:
        inner = tag in ("ul", "ol", "menu", "dir") and lists
        flows[-1].block(2 if tag in SPACED and not inner else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(node.attributes.get("start", ""), 1)])


def _leave(node: Node, flows: list[Flow], lists: list[list], tables: list[list]) -> None:
    tag = node.tag
    if tag == "text":
        flows[-1].block(1)
    elif tag == "table":
        loose, (rows, open_row) = flows.pop().done(), tables.pop()
        flows[-1].insert(loose, 2)
        flows[-1].insert(aligned(rows + ([open_row] if open_row else [])), 2)
    elif tag == "tr" and tables:
        if tables[-1][1]:
            tables[-1][0].append(tables[-1][1])
        tables[-1][1] = None
    elif tag in ("td", "th"):
        lines = flows.pop().done()
        if tables and tables[-1][1] is not None:
            tables[-1][1].append((lines, min(100, max(1, _number(node.attributes.get("colspan", ""), 1)))))
        else:
            flows[-1].insert(lines, 1)
    elif tag == "caption":
        lines = flows.pop().done()
        flows[-1].insert(lines, 1)
    elif tag == "li":
        lines = flows.pop().done()
        mark = "- "
        if lists and lists[-1][0] == "ol":
            mark = f"{lists[-1][1]}. "
            lists[-1][1] += 1
        if lines:
            flows[-1].insert([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])], 1)
    elif tag in ("blockquote", "dd"):
        lines = flows.pop().done()
        indent = "> " if tag == "blockquote" else "  "
        flows[-1].insert([(indent + x).rstrip() for x in lines], 2 if tag == "blockquote" else 1)
    elif tag in BLOCK:
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        inner = tag in ("ul", "ol", "menu", "dir") and lists
        flows[-1].block(2 if tag in SPACED and not inner else 1)


def title(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in FOREIGN]
    return None


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, title, text, n_lines.

    text is what a reader sees: blocks on lines of their own, paragraphs, headings, lists and tables behind an empty line, list items
    behind "- " or their number and indented below, table cells padded to columns, preformatted text as it is. Hidden are
    head, scripts, styles and the like, `hidden`, display:none (by style attribute, or by a rule for one tag, class or id that holds
    on any screen: blocks with conditions, as of @media print or (max-width: ...) or @supports, hide nothing),
    visibility:hidden unless an inner element is visible, closed details and dialogs. Shown are all options of a list, each on a line, what a textarea
    holds, formulas, and the texts of drawings, each on a line. A null page has a null text, an empty
    page an empty one; page_id and repeated rows are passed through; other columns are not looked at. Nothing is shuffled.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for source in batch.column(1).to_pylist():
                root = parse(source) if source is not None else None
                titles.append(title(root) if root else None)
                texts.append(render(root) if root else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["page_id", "title", "text"])

    bounded(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    found = own.mapInArrow(read, "page_id long, title string, text string")
    return found.withColumn("n_lines", F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(F.when(F.col("text").isNotNull(), 0)).cast("long"))
