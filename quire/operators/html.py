"""Manual pages in HTML to command entries and headings with blocks.

Parsing is Python over Arrow batches; all that follows it (numbering, chapter titles, indexes) is DataFrame work.
"""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import dom
from quire.operators.arrow import mapped
from quire.operators.dom import HEADINGS, Node, collapse

SYNTAX_LABELS = ("入力形式", "入力例")
_AUTOMATIC = re.compile(r"id\d*\Z")
_BRACKETS = re.compile(r"\s*[\[［]\s*(.*?)\s*[\]］]\s*\Z")

# ---- lines ----

_JAPANESE = re.compile("[぀-ヿ一-鿿㐀-䶿ｦ-ﾝ]")


def is_layout(line: str) -> bool:
    """The rule of functions.text.line_rule, for one line."""
    t = line.strip()
    if not t or (t[0] in T.BULLETS and not re.match(r"※\s*\d", t)) or t[-1] in "。！？!?":
        return False
    gap = max((len(x) for x in re.findall(" +", line.strip(" "))), default=0)
    return gap >= 3 or not _JAPANESE.search(t) or len(t) < 22


def raw_lines(n: Node) -> list[str]:
    """Lines as set: of a pre, or of a line block with two spaces for each level of nesting; else the prose."""
    if n.tag == "pre":
        return [x.rstrip(" \t") for x in n.text().strip("\n").split("\n")]
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(n, 0)]
    while stack:
        k, depth = stack.pop()
        if k.tag == "div" and k.has("line") and not k.has("line-block"):
            t = collapse(k.text())
            out.append(("" if t.startswith("no ") else "  " * max(depth - 1, 0)) + t)
        else:
            stack += [(e, depth + (k.tag == "div" and k.has("line-block"))) for e in reversed(k.elements())]
    return out or [x for x in prose_lines(n) if x]


def prose_lines(n: Node) -> list[str]:
    """Each logical line, followed by an empty one."""
    return [x for s in _prose(n, "") if s.strip() for x in (s.rstrip(" "), "")]


def _prose(n: Node | str, indent: str):
    if isinstance(n, str):
        yield indent + collapse(n)
    elif n.tag == "li":
        own = [collapse(k if isinstance(k, str) else k.text()) for k in n.kids if isinstance(k, str) or k.tag not in ("ul", "ol")]
        yield f"{indent}- {' '.join(x for x in own if x)}"
        for k in n.elements():
            if k.tag in ("ul", "ol"):
                yield from _prose(k, indent + "  ")
    elif n.tag == "table":
        for row in table_rows(n):
            yield f"{indent}| {' | '.join(c.replace('\n', ' / ') for c in row)} |"
    elif n.tag == "pre":
        yield from (indent + x for x in raw_lines(n))
    elif n.tag in ("img", "figure"):
        return
    elif n.tag == "aside" and n.has("footnote") and not n.has("footnote-list"):
        yield indent + collapse(n.text())
    elif n.tag in ("ul", "ol", "dd", "dl", "blockquote", "div", "section", "span", "nav", "aside", "article", "body", "main"):
        if n.tag != "aside" and n.has("admonition-title"):
            yield f"{indent}{collapse(n.text())}:"
        elif n.tag == "aside" or not n.has("toctree-wrapper"):
            for k in n.kids:
                yield from _prose(k, indent)
    else:
        yield indent + collapse(n.text())


# ---- tables ----


def _span(s: str | None) -> int:
    try:
        return max(1, int(s or 1))
    except ValueError:
        return 1


def cell_text(cell: Node) -> str:
    parts: list[str] = []
    for k in cell.kids:
        if isinstance(k, Node) and k.tag == "div" and k.has("line-block"):
            parts += raw_lines(k)
        elif t := collapse(k if isinstance(k, str) else k.text()):
            parts.append(t)
    return "\n".join(parts)


def spread(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Rows of cells (text, colspan, rowspan) to a grid in which a spanning cell's text fills every place it covers."""
    out: list[list[str]] = []
    below: list[dict[int, str]] = [{} for _ in range(len(rows) + 1)]
    for r, cells in enumerate(rows):
        row: list[str] = []
        held = below[r]
        for text, wide, high in cells:
            while len(row) in held:
                row.append(held[len(row)])
            for _ in range(wide):
                for d in range(r + 1, min(r + high, len(rows))):
                    below[d][len(row)] = text
                row.append(text)
        while len(row) in held:
            row.append(held[len(row)])
        out.append(row)
    return out


def table_rows(table: Node) -> list[list[str]]:
    rows = [n for n in table.within(skip=lambda n: n.tag == "tr") if n.tag == "tr"]
    return spread([[(cell_text(c), _span(c.attrs.get("colspan")), _span(c.attrs.get("rowspan"))) for c in r.elements() if c.tag in ("td", "th")] for r in rows])


# ---- blocks ----


class _Blocks:
    def __init__(self, page: str):
        self.page, self.out = page, []

    def put(self, kind: str, lines=None, rows=None, source: str = "") -> None:
        if kind == "prose" and not lines:
            return
        if kind == "prose" and self.out and self.out[-1]["kind"] == "prose":
            self.out[-1]["lines"] += lines
        else:
            self.out.append({"kind": kind, "lines": lines or [], "rows": rows or [], "figure_source": source})

    def add(self, n: Node) -> None:
        box = n.tag in ("div", "blockquote") or (n.tag == "aside" and n.has("footnote-list"))
        if n.tag == "table":
            self.put("table", rows=table_rows(n))
        elif n.tag in ("figure", "img"):
            self.figure(n)
        elif n.tag == "pre":
            self.put("layout", raw_lines(n))
        elif n.tag == "div" and n.has("line-block"):
            lines = raw_lines(n)
            if lines and not any(map(is_layout, lines)):
                self.put("prose", [y for x in lines for y in (x, "")])
            else:
                self.put("layout", lines)
        elif n.tag == "div" and n.has("toctree-wrapper"):
            return
        elif box and not n.has("admonition"):
            for k in n.elements():
                self.add(k)
        else:
            self.put("prose", prose_lines(n))
            for k in n.within(skip=lambda k: k.tag in ("figure", "img")):
                if k.tag in ("figure", "img"):
                    self.figure(k)

    def figure(self, n: Node) -> None:
        image = n if n.tag == "img" else n.first(lambda k: k.tag == "img")
        if image is not None:
            self.put("figure", source=posixpath.normpath(posixpath.join(posixpath.dirname(self.page), image.attrs.get("src", ""))))
            if (caption := n.first(lambda k: k.tag == "figcaption")) is not None:
                self.put("prose", [collapse(caption.text()), ""])


def blocks(nodes: list[Node], page: str) -> list[dict]:
    b = _Blocks(page)
    for n in nodes:
        b.add(n)
    return b.out


# ---- pages ----


def heading_parts(n: Node) -> tuple[list[int], str]:
    """The section number as whole numbers (none where a part isn't one), and the title without it."""
    number, title = "", []
    stack: list[Node | str] = [n]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            title.append(k)
        elif k.tag == "span" and k.has("section-number"):
            number = k.text()
        elif not (k.tag == "a" and k.has("headerlink")):
            stack += reversed(k.kids)
    parts = [x.strip() for x in number.strip().removesuffix(".").strip().split(".")]
    return [int(x) for x in parts] if all(re.fullmatch("[0-9]+", x) for x in parts) else [], collapse("".join(title))


def anchor(section: Node) -> str:
    """A leading label of the author's before the heading, else the section's own id."""
    for k in section.elements():
        if k.tag in HEADINGS:
            break
        if k.tag == "span" and k.attrs.get("id") and not _AUTOMATIC.match(k.attrs["id"]):
            return k.attrs["id"]
    return section.attrs.get("id", "")


def article(root: Node) -> tuple[Node, Node, Node] | None:
    """(article body, its first section, that one's first h1)."""
    body = root.first(lambda n: n.attrs.get("itemprop") == "articleBody")
    section = body and body.first(lambda n: n.tag == "section")
    h1 = section and section.first(lambda n: n.tag == "h1")
    return (body, section, h1) if h1 else None


def page_head(html: str, unnumbered: bool) -> dict | None:
    """number, title, chapter_title and unnumbered of a page; None for a page that the book leaves out."""
    root = dom.parse(html)
    if (found := article(root)) is None:
        return None
    number, title = heading_parts(found[2])
    if not number and not unnumbered:
        return None
    chapter = title
    if number:
        for n in root.within():
            if n.tag == "li" and n.has("breadcrumb-item"):
                own, text = heading_parts(n)
                if own == number[:1]:
                    chapter = text
    return {"number": number, "title": title, "chapter_title": chapter, "unnumbered": not number}


def label(n: Node) -> str:
    t = collapse(n.text())
    t = m[1] if (m := _BRACKETS.match(t)) else t
    return T.LABELS.get(t, t)


def _field_lines(name: str, n: Node) -> list[str]:
    return raw_lines(n) if name in SYNTAX_LABELS else prose_lines(n)


def fields(section: Node, labels: frozenset[str]) -> list[dict]:
    """Fields of a section: from definition lists, or from label paragraphs up to the next label."""
    out: list[dict] = []
    open_ = False
    for n in section.elements():
        if n.tag == "section":
            break
        if n.tag == "dl":
            open_, kids = False, n.elements()
            for i, d in enumerate(kids):
                if d.tag == "dt" and (name := label(d)) in labels:
                    dd = next((k for k in kids[i + 1 :] if k.tag == "dd"), None)
                    out.append({"label": name, "lines": _field_lines(name, dd) if dd else []})
        elif not open_ and n.tag in ("blockquote", "div"):
            out += fields(n, labels)
        elif n.tag == "p" and label(n) in labels:
            out.append({"label": label(n), "lines": []})
            open_ = True
        elif open_:
            out[-1]["lines"] += _field_lines(out[-1]["label"], n)
    return out


def page_entries(path: str, html: str, title: str, labels: frozenset[str], unnumbered: bool) -> list[dict]:
    """Every outermost section that has fields."""
    found = article(dom.parse(html))
    out: list[dict] = []
    known: dict[int, list[dict]] = {}
    of = lambda n: known.setdefault(id(n), fields(n, labels) if n.tag == "section" else [])
    for n in found[0 if unnumbered else 1].within(skip=lambda n: bool(of(n))) if found else ():
        if of(n):
            h = n.first(lambda k: k.tag in HEADINGS)
            out.append({"path": path, "ord": len(out), "title": heading_parts(h)[1] if h else "", "section": title, "anchor": anchor(n), "fields": of(n)})
    return out


def page_headings(path: str, html: str, title: str, unnumbered: bool) -> list[dict]:
    """Sections in order; an unnumbered one in a numbered page is left out with all below it."""
    found = article(dom.parse(html))
    out: list[dict] = []
    stack = [found[0 if unnumbered else 1]] if found else []
    while stack:
        s = stack.pop()
        h = next((k for k in s.elements() if k.tag in HEADINGS), None)
        inner = [k for k in s.elements() if k.tag == "section"]
        if h is not None:
            number, name = heading_parts(h)
            if not number and not unnumbered:
                continue
            content = [k for k in s.elements() if k.tag != "section" and k is not h]
            out.append({"path": path, "ord": len(out), "number": ".".join(map(str, number)), "title": name, "depth": int(h.tag[1]) if unnumbered else len(number), "section": title, "anchor": anchor(s), "blocks": blocks(content, path)})
        stack += reversed(inner)
    return out


# ---- DataFrames ----

_HEAD = "path string, html string, number array<int>, title string, chapter_title string, unnumbered boolean"


def read_pages(pages: DataFrame, unnumbered: bool = False, book: str | None = None) -> DataFrame:
    """Rows (path, html) to the book's pages, with `place` to order them; unnumbered ones get chapters after the highest, in order of their folders and names.

    Pages without an article, a section or an h1 are left out, and unnumbered ones unless asked for.
    """
    key = book or "book"
    t = pages.select((F.col(book) if book else F.lit("")).cast("string").alias("book"), "path", "html")
    t = mapped(t, lambda r: [r | h] if (h := page_head(r["html"], unnumbered)) else [], "book string, " + _HEAD)
    # chapters for the unnumbered pages alone: no page's text goes through the window
    last = t.groupBy("book").agg(F.coalesce(F.max(F.get("number", F.lit(0))), F.lit(0)).alias("last"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.split("path", "/")))
    given = t.where("unnumbered").select("book", "path", rank.alias("rank")).join(last, "book").select("book", "path", F.array((F.col("last") + F.col("rank")).cast("int")).alias("given"))
    t = t.join(given, ["book", "path"], "left").withColumn("number", F.coalesce("given", "number")).drop("given")
    t = t.withColumn("place", F.struct("number", F.split("path", "/").alias("walk")))
    return t.withColumnRenamed("book", key) if book else t.drop("book")


_ENTRY = "path string, ord int, title string, section string, anchor string, fields array<struct<label:string,lines:array<string>>>"
_BLOCK = "struct<kind:string,lines:array<string>,rows:array<array<string>>,figure_source:string>"
_HEADING = f"path string, ord int, number string, title string, depth int, section string, anchor string, blocks array<{_BLOCK}>"


def entries(pages: DataFrame, labels: list[str]) -> DataFrame:
    """Command entries of read_pages(): with chapter, place, source and the commands of their syntax fields."""
    from quire.functions.commands import SYNTAX, commands_of

    names = frozenset(T.LABELS.get(x, x) for x in labels)
    t = mapped(pages.select("path", "html", "title", "unnumbered"), lambda r: page_entries(r["path"], r["html"], r["title"], names, r["unnumbered"]), _ENTRY)
    t = t.join(pages.select("path", "place", F.get("number", F.lit(0)).alias("chapter")), "path")
    lines = F.flatten(F.transform(F.filter("fields", lambda f: f["label"] == SYNTAX), lambda f, i: F.transform(f["lines"], lambda x: F.struct(i.alias("field"), x.alias("line")))))
    return t.withColumn("cmds", commands_of(lines)).withColumn("source", T.source_ref(F.col("path"), F.col("anchor"), F.lit(0)))


def headings(pages: DataFrame) -> DataFrame:
    """Headings of read_pages() with their blocks, chapter, place and source."""
    t = mapped(pages.select("path", "html", "title", "unnumbered"), lambda r: page_headings(r["path"], r["html"], r["title"], r["unnumbered"]), _HEADING)
    t = t.join(pages.select("path", "place", F.get("number", F.lit(0)).alias("chapter")), "path")
    return t.withColumn("source", T.source_ref(F.col("path"), F.col("anchor"), F.lit(0)))


def chapter_titles(pages: DataFrame) -> DataFrame:
    """The chapter titles; the last page of a chapter wins."""
    return pages.groupBy(F.get("number", F.lit(0)).alias("chapter")).agg(F.max_by("chapter_title", "place").alias("title"))


def page_blocks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Blocks of any page's article, or of its body: rows (key, ord, kind, lines, rows, figure_source). A null page has none."""

    def of(r: dict) -> list[dict]:
        root = dom.parse(r["html"])
        top = root.first(lambda n: n.tag == "article") or root.first(lambda n: n.tag == "body") or root
        return [{"key": r["key"], "ord": i} | b for i, b in enumerate(blocks(top.elements(), ""))]

    kind = pages.schema[key].dataType.simpleString()
    return mapped(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), of, f"key {kind}, ord int, kind string, lines array<string>, rows array<array<string>>, figure_source string").withColumnRenamed("key", key)


def list_items(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The items of a page's navigation lists: rows (key, ord, item)."""

    def of(r: dict) -> list[dict]:
        items = [collapse(n.text()) for nav in dom.parse(r["html"]).within() if nav.tag == "nav" for n in nav.within() if n.tag == "li"]
        return [{"key": r["key"], "ord": i, "item": x} for i, x in enumerate(items)]

    kind = pages.schema[key].dataType.simpleString()
    return mapped(pages.select(F.col(key).alias("key"), F.col(html).alias("html")), of, f"key {kind}, ord int, item string").withColumnRenamed("key", key)


def spread_cells(cells: DataFrame, table: str) -> DataFrame:
    """Rows (table, row, cell, colspan, rowspan, text) of cells in reading order to (table, row, col, text): each place that a cell covers."""
    from quire.operators.arrow import grouped

    def of(rows: list[dict]) -> list[dict]:
        lines: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["row"], r["cell"])):
            lines.setdefault(r["row"], []).append((r["text"], _span(r["colspan"]), _span(r["rowspan"])))
        grid = spread([lines.get(i, []) for i in range(max(lines) + 1)])
        return [{table: rows[0][table], "row": i, "col": j, "text": x} for i, row in enumerate(grid) for j, x in enumerate(row)]

    kind = cells.schema[table].dataType.simpleString()
    return grouped(cells, [table], of, f"{table} {kind}, row int, col int, text string")


# ---- figures ----

# Fixed value: a transform of six numbers.
_MATRIX = re.compile(r"matrix\(\s*([-\d.eE+]+)\s+([-\d.eE+]+)\s+([-\d.eE+]+)\s+([-\d.eE+]+)\s+([-\d.eE+]+)\s+([-\d.eE+]+)\s*\)")


def _number(s: str | None, default: float = 0.0) -> float:
    try:
        return float((s or "").split()[0])
    except (ValueError, IndexError):
        return default


def svg_labels(svg: str) -> list[str]:
    """The text of a drawing by lines: from top to bottom and left to right, close pieces joined, others two spaces apart."""
    try:
        root = ET.fromstring(svg)
    except ET.ParseError:
        return []
    items = []
    for e in root.iter():
        if e.tag.rpartition("}")[2] == "text" and (s := collapse("".join(e.itertext()))):
            m = _MATRIX.search(e.get("transform", ""))
            x, y = (float(m[5]), float(m[6])) if m else (_number(e.get("x")), _number(e.get("y")))
            items.append((s, x, y, _number((e.get("font-size") or "").removesuffix("px"), 12.0)))
    items.sort(key=lambda t: t[2])
    lines: list[list[tuple]] = []
    for t in items:
        if lines and abs(t[2] - lines[-1][-1][2]) < lines[-1][-1][3] / 2:
            lines[-1].append(t)
        else:
            lines.append([t])
    out = []
    for line in lines:
        text, end = "", None
        for s, x, _, size in sorted(line, key=lambda t: t[1]):
            text += s if end is None or x - end < size / 2 else "  " + s
            end = x + sum(size * (0.55 if ord(c) < 128 else 1) for c in s)
        out.append(text)
    return out
