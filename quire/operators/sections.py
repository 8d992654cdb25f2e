"""Headings and blocks of a section book's pages: an ordered fold over a document's lines, with three values of state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import layout
from quire.operators.arrow import grouped, mapped
from quire.operators.html import is_layout

_ASCII = str.maketrans("０１２３４５６７８９．", "0123456789.")


class _Fold:
    """Layout lines wait until it is known where their block ends; one blank line may lie inside it."""

    def __init__(self):
        self.heads: list[dict] = []
        self.held: list[str] = []
        self.page, self.hole = 0, 0

    def prose(self, line: str, page: int) -> None:
        if self.heads:
            own = self.heads[-1]["blocks"]
            if own and own[-1]["kind"] == "prose":
                own[-1]["lines"].append(line)
            else:
                own.append({"kind": "prose", "page": page, "lines": [line], "rows": []})

    def close(self) -> None:
        held, self.held, self.hole = self.held, [], 0
        if len(held) == 1:  # a line by itself is prose
            self.prose(held[0], self.page)
            self.prose("", self.page)
        elif held and self.heads:
            self.heads[-1]["blocks"].append({"kind": "layout", "page": self.page, "lines": held, "rows": []})

    def table(self, rows: list, page: int) -> None:
        self.close()
        if self.heads:
            self.heads[-1]["blocks"].append({"kind": "table", "page": page, "lines": [], "rows": rows})

    def line(self, r: dict) -> None:
        raw, page = r["line"], r["page"]
        t = raw.strip()
        if layout.LEADER.search(raw):
            return
        m = layout.HEADING.match(t)
        if m:
            number = m[2].translate(_ASCII)
            chapter = int(number.split(".")[0])
            if (not r["chapter"] or chapter == r["chapter"]) and (r["headings"] is None or "".join(t.split()) in r["headings"]):
                self.close()
                self.heads.append({"number": number, "title": m[3], "depth": number.count(".") + 1, "chapter": r["chapter"], "section": r["section"], "page": page, "blocks": []})
                return
        if not self.heads:
            return
        if not t:
            if self.held:
                self.hole += 1
                if self.hole > 1:
                    self.close()
            else:
                self.prose("", page)
        elif is_layout(raw):
            if not self.held:
                self.page = page
            self.held += [""] * self.hole + [raw.rstrip(" ")]
            self.hole = 0
        else:
            self.close()
            self.prose(raw, page)


def _page(glyphs: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows (doc, page, glyphs, tables): a page is a bounded group."""
    a = glyphs.groupBy("doc", "page").agg(F.collect_list(F.struct("seq", "r", "left", "right", "top", "bottom", "space_before", "width")).alias("glyphs"))
    b = tables.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "left", "right", "top", "bottom", "rows"))).alias("tables"))
    return a.join(b, ["doc", "page"], "full")


def _free(r: dict) -> list[dict]:
    """The page's glyphs in none of its tables, in their order."""
    mid = lambda g: ((g["left"] + g["right"]) / 2, (g["top"] + g["bottom"]) / 2)
    inside = lambda g, t: t["left"] <= mid(g)[0] <= t["right"] and t["bottom"] <= mid(g)[1] <= t["top"]
    return [g for g in sorted(r["glyphs"] or [], key=lambda g: g["seq"]) if not any(inside(g, t) for t in r["tables"] or [])]


def placed_tables(glyphs: DataFrame, tables: DataFrame) -> DataFrame:
    """page_tables() rows with nothing_above and nothing_below: no glyph of the body stands above or below the table."""

    def of(r: dict) -> list[dict]:
        y = [(g["top"] + g["bottom"]) / 2 for g in _free(r)]
        return [{"doc": r["doc"], "page": r["page"], "ord": t["ord"], "nothing_above": not any(v > t["top"] for v in y), "nothing_below": not any(v < t["bottom"] for v in y)} for t in r["tables"] or []]

    return tables.join(mapped(_page(glyphs, tables), of, "doc string, page int, ord int, nothing_above boolean, nothing_below boolean"), ["doc", "page", "ord"])


def page_lines(glyphs: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows (doc, page, line_no, line, rows) of pages in reading order: text from above each table, then a row that holds its cells, then the rest."""

    def of(r: dict) -> list[dict]:
        left, out = _free(r), []

        def text(some: list[dict]) -> None:
            out.extend((x, None) for x in layout.render(some).rstrip("\n").split("\n"))

        for t in sorted(r["tables"] or [], key=lambda t: (-t["top"], t["left"])):
            above = [g for g in left if (g["top"] + g["bottom"]) / 2 > t["top"]]
            if above:
                text(above)
            left = [g for g in left if (g["top"] + g["bottom"]) / 2 <= t["top"]]
            out.append(("", t["rows"]))
        if left:
            text(left)
        return [{"doc": r["doc"], "page": r["page"], "line_no": i + 1, "line": x, "rows": rows} for i, (x, rows) in enumerate(out)]

    return mapped(_page(glyphs, tables), of, "doc string, page int, line_no int, line string, rows array<array<string>>")


_BLOCK = "struct<kind:string,page:int,lines:array<string>,rows:array<array<string>>>"


def headings(lines: DataFrame) -> DataFrame:
    """Rows (doc, page, line_no, line, rows, chapter, section, headings) to headings with blocks.

    A line with `rows` is a table's place; `headings` holds the keys of the page's large headings, null where any numbered line
    may be one. Table places come first, then leaders of tables of contents (left out), headings, and the rest.
    Layout blocks end with their page. One document is a bounded group.
    """

    def of(rows: list[dict]) -> list[dict]:
        f, page = _Fold(), None
        for r in sorted(rows, key=lambda r: (r["page"], r["line_no"])):
            if r["page"] != page:
                f.close()
                page = r["page"]
            if r["rows"] is not None:
                f.table(r["rows"], page)
            else:
                f.line(r)
        f.close()
        return [{"doc": rows[0]["doc"], "ord": i} | h for i, h in enumerate(f.heads)]

    cols = ["doc", "page", "line_no", "line", "rows", "chapter", "section", "headings"]
    have = [c if c in lines.columns else F.lit(None).cast({"rows": "array<array<string>>", "headings": "array<string>", "chapter": "int", "section": "string"}[c]).alias(c) for c in cols]
    return grouped(lines.select(*have), ["doc"], of, f"doc string, ord int, number string, title string, depth int, chapter int, section string, page int, blocks array<{_BLOCK}>")
