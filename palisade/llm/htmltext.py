"""Layout-aware text of HTML pages: a tree builder with implied tags and visibility rules, rendered from the leaves up.

An element is laid out when it closes: inline content joins its parent's line, a block becomes lines of its parent, list items get markers and
hanging indents, table rows wait for their table, which aligns the columns.  No recursion, so nesting may be of any depth.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed sets of element names of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title template".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas object svg math".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu dir".split())
BLOCK = SPACED | frozenset(
    "address article aside body center details dialog dd div dt figcaption footer form header hgroup html li legend main nav section summary caption optgroup option select".split())
CLOSES_P = (BLOCK - frozenset("caption optgroup option select body html".split())) | {"p"}
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("html head title meta link base basefont bgsound style script noscript noframes template".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset(("td", "th"))
#: Start tag: elements it ends, elements beyond which it does not look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    **{s: (SECTIONS | {"tr", "caption"}, {"table"}) for s in SECTIONS}, "caption": ({"caption"}, {"table"}), "body": ({"head"}, set()),
}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE, _UNSEEN, _SEEN = (re.compile(rf"(?:^|;)\s*{rule}\s*(?:!important\s*)?(?:;|$)", re.I) for rule in (r"display\s*:\s*none", r"visibility\s*:\s*(?:hidden|collapse)", r"visibility\s*:\s*visible"))
# stand for a space, a line end that white-space collapsing must keep, and a line break
_KEEP, _BREAK = "\ue000", "\ue001"


class Element:
    __slots__ = ("name", "attrs", "shown", "seen", "pre", "parts", "items")

    def __init__(self, name, attrs, shown, seen, pre):
        self.name, self.attrs, self.shown, self.seen, self.pre = name, attrs, shown, seen, pre
        self.parts: list = []  # str, or (lines, spaced), or a row: list of cells
        self.items = 0


def lines_of(parts: list) -> list[str]:
    """Lines of a block from its inline text and the blocks inside; a blank line around spaced ones.  Rows without a table are laid out as one."""
    out: list[str] = []
    run: list[str] = []
    rows: list[list] = []
    gap = False

    def put(lines, spaced):
        nonlocal gap
        if not lines:
            return
        if out and (gap or spaced):
            out.append("")
        out.extend(lines)
        gap = spaced

    def flush():
        if rows:
            put(table_lines(rows), True)
            rows.clear()
        if run:
            text = _SPACE.sub(" ", "".join(run))
            run.clear()
            found = [x.strip(" ").replace(_KEEP, " ").rstrip() for x in text.split(_BREAK)]
            while found and not found[-1]:
                found.pop()
            while found and not found[0]:
                found.pop(0)
            put(found, False)

    for part in parts:
        if isinstance(part, str):
            if rows:
                flush()
            run.append(part)
        elif isinstance(part, tuple):
            flush()
            put(*part)
        else:
            if run:
                flush()
            rows.append(part)
    flush()
    return out


def table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (lines, columns spanned): columns padded to their widest cell that spans one; two spaces between columns."""
    width: dict[int, int] = {}
    placed = []
    for row in rows:
        at, cells = 0, []
        for lines, span in row:
            cells.append((at, lines))
            if span == 1:
                width[at] = max([width.get(at, 0), *map(len, lines)])
            at += span
        placed.append((cells, at))
    out = []
    for cells, _ in placed:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line, column = "", 0
            for at, lines in cells:
                while column < at:  # columns that an earlier cell spans
                    line, column = line.ljust(sum(width.get(c, 0) + 2 for c in range(at))), at
                text = lines[i] if i < len(lines) else ""
                line, column = line + text.ljust(width.get(at, 0)) + "  ", at + 1
            out.append(line.rstrip())
    return out


class Builder:
    """Open elements, from the root to the current one."""

    def __init__(self) -> None:
        self.open = [Element("#root", {}, True, True, False)]
        self.count: dict[str, int] = {}

    def text(self, data: str) -> None:
        if self.open[-1].name == "head" and data.strip(" \t\n\r\f"):
            self.close()
        top = self.open[-1]
        if top.shown and top.seen and data:
            data = html.unescape(data).replace(_KEEP, "").replace(_BREAK, "")
            if top.pre:
                data = data.replace("\r\n", "\n").expandtabs(8).replace("\n", _BREAK).replace(" ", _KEEP)
            top.parts.append(data)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if self.open[-1].name == "head":
            if name == "head":
                return
            if name not in IN_HEAD:
                self.close()
        inside = self.count.get("table", 0) > 0
        if (name in CELLS or name == "tr" or name in SECTIONS or name == "caption") and not inside:
            return
        if name in ("html", "body") and self.count.get(name, 0):
            return
        if name in CLOSES_P and self.count.get("p", 0):
            self.end_within({"p"}, CELLS | {"table", "button"})
        if name in IMPLIED_END:
            self.end_within(*IMPLIED_END[name])
        if name in CELLS and not self.within("tr"):
            self.start("tr", {})
        top = self.open[-1]
        style = attrs.get("style", "")
        shown = top.shown and name not in HIDDEN and "hidden" not in attrs and not (style and _NONE.search(style)) and not (name == "dialog" and "open" not in attrs)
        seen = top.seen
        if style:
            seen = (seen or bool(_SEEN.search(style))) and not _UNSEEN.search(style)
        if name in VOID:
            if shown and name == "br":
                top.parts.append(_BREAK)
            elif shown and name == "hr":
                top.parts.append(([], True))
            return
        if name == "ol":
            digits = attrs.get("start", "")
            first = int(digits) if re.fullmatch(r"-?\d{1,9}", digits) else 1
        element = Element(name, attrs, shown, seen, top.pre or name in ("pre", "textarea", "xmp"))
        if name == "ol":
            element.items = first - 1
        self.open.append(element)
        self.count[name] = self.count.get(name, 0) + 1

    def within(self, name: str) -> bool:
        for e in reversed(self.open):
            if e.name == name:
                return True
            if e.name == "table":
                return False
        return False

    def end_within(self, names, barrier) -> None:
        """Close the nearest open element of these names, and for table parts the outermost one, unless a barrier stands before it."""
        if not any(self.count.get(n) for n in names):
            return
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                last = i
            elif self.open[i].name in barrier:
                break
        if last is not None:
            self.close_to(last)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
            return
        if not self.count.get(name):
            return
        for i in range(len(self.open) - 1, 0, -1):
            found = self.open[i].name
            if found == name:
                self.close_to(i)
                return
            if found == "table" or found in CELLS and name not in CELLS and name not in ("table", "tr") and name not in SECTIONS:
                return

    def close_to(self, i: int) -> None:
        while len(self.open) > i:
            self.close()

    def close(self) -> None:
        e, parent = self.open.pop(), self.open[-1]
        self.count[e.name] -= 1
        if not e.shown:
            return
        name = e.name
        if name not in CELLS and name not in SECTIONS and name not in ("tr", "table") and self.count.get("table", 0):
            # an element between cells or rows and their table, such as a form: they go on to the table
            held = [p for p in e.parts if isinstance(p, list)]
            if held:
                parent.parts.extend(held)
                e.parts = [p for p in e.parts if not isinstance(p, list)]
        if name in CELLS:
            span = e.attrs.get("colspan", "")
            parent.parts.append([(lines_of(e.parts), max(1, int(span)) if re.fullmatch(r"\d{1,3}", span) else 1)])
        elif name == "tr":
            loose = [p for p in e.parts if not isinstance(p, list)]
            parent.parts.extend(p for p in loose if not isinstance(p, str) or p.strip())
            parent.parts.append([c for p in e.parts if isinstance(p, list) for c in p])
        elif name in SECTIONS:
            parent.parts.extend(p for p in e.parts if not isinstance(p, str) or p.strip())
        elif name == "table":
            rows = [p for p in e.parts if isinstance(p, list)]
            parent.parts.append((lines_of([p for p in e.parts if not isinstance(p, list)]), False))
            parent.parts.append((table_lines(rows), True))
        elif name == "li":
            parent.items += 1
            mark = f"{parent.items}. " if parent.name == "ol" else "- "
            own = lines_of(e.parts)
            parent.parts.append(([(mark if j == 0 else " " * len(mark)) + x if x else x for j, x in enumerate(own)], False))
        elif name in ("blockquote", "dd"):
            parent.parts.append((["  " + x if x else x for x in lines_of(e.parts)], name == "blockquote"))
        elif name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and self.count.get("li", 0) > 0
            parent.parts.append((lines_of(e.parts), name in SPACED and not nested))
        else:
            parent.parts.extend(e.parts)


def visible_text(page: str | None) -> str:
    """All visible text of a page, laid out; empty for null and empty pages.  Whatever the markup, no input is rejected."""
    if not page:
        return ""
    tree, at, last = Builder(), 0, page.rfind(">")
    while True:
        i = page.find("<", at)
        if i < 0 or i > last:
            tree.text(page[at:])
            break
        if i > at:
            tree.text(page[at:i])
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = len(page) if j < 0 else j + 3
            continue
        if page.startswith(("<!", "<?", "</"), i) and not page[i + 2 : i + 3].isalpha() or page.startswith("<!", i):
            at = page.find(">", i) + 1
            continue
        m = _TAG.match(page, i) or _LOOSE.match(page, i)
        if not m:
            tree.text("<")
            at = i + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            tree.end(name)
            continue
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(m[3])} if m[3] else {}
        tree.start(name, attrs)
        if name in RAW and name not in VOID:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if name in ("textarea", "xmp"):
                tree.text(page[at:stop])
            close = page.find(">", stop)
            at = len(page) if close < 0 else close + 1
            tree.end(name)
    tree.close_to(1)
    return "\n".join(lines_of(tree.open[0].parts))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The rows with a column of their visible text ('' for null and empty pages); a column of that name is replaced."""
    schema = T.StructType([*[f for f in pages.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def add(batches):
        for b in batches:
            texts = [visible_text(h) for h in b.column(html_col).to_pylist()]
            kept = [n for n in b.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(texts, pa.string())], names=[*kept, out])

    return pages.mapInArrow(add, schema)
