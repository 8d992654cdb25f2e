"""Text out of positioned glyphs: rows (doc, page, seq, r, left, right, top, bottom, size, space_before, width, height), in points from the lower left.

Cuts and statistics are DataFrame filters and aggregations; the order-dependent steps run a page at a time.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.arrow import grouped
from quire.operators.lines import mode

# Ranges of characters that take two columns, of punctuation that keeps no gap, and the fallback column width.
WIDE = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6))
PUNCTUATION = ((0x3000, 0x303F), (0xFF01, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
COLUMN = 4.8
# Numbered headings, and the leaders of tables of contents.
HEADING = re.compile(r"(■)?\s*([0-9０-９]+(?:[.．][0-9０-９]+)+)[\s　]+(\S.*?)\s*\Z")
LEADER = re.compile(r"(?:[.·．・][\s　]*){6,}")
# Shares by which a glyph overlaps its line, a flat glyph is high and lies near; wide steps that settle a page's and a line's
# unit; shares of a unit that part words, of a glyph's height that a unit has at least, and up to which words stay one column apart.
OVERLAP, FLAT, NEAR_FLAT = 0.35, 0.35, -0.25
PAGE_STEPS, LINE_STEPS = 20, 3
GAP, LEAST_UNIT, CLOSE = 0.9, 0.55, 1.8


# ---- cuts ----


def kept(left: float = 0, right: float = 0, top: float = 0, bottom: float = 0) -> Column:
    """Glyphs whose centre is inside the page less these margins; a margin of 0 doesn't cut."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    ok = F.lit(True)
    if left > 0:
        ok &= x >= left
    if right > 0:
        ok &= x <= F.col("width") - right
    if top > 0:
        ok &= y <= F.col("height") - top
    if bottom > 0:
        ok &= y >= bottom
    return ok


def outside(glyphs: DataFrame, tables: DataFrame) -> DataFrame:
    """Glyphs whose centre is in none of the page's tables (doc, page, t_left, t_right, t_top, t_bottom)."""
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    t = tables.select(F.col("doc").alias("t_doc"), F.col("page").alias("t_page"), "t_left", "t_right", "t_top", "t_bottom")
    on = (F.col("doc") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & x.between(F.col("t_left"), F.col("t_right")) & y.between(F.col("t_bottom"), F.col("t_top"))
    return glyphs.join(t, on, "left_anti")


def folded_spaces(chars: DataFrame) -> DataFrame:
    """Raw characters to glyphs: white space goes and marks the next glyph, U+0002 is a hyphen, other controls go."""
    w = Window.partitionBy("doc", "page").orderBy("seq")
    r = F.when(F.col("r") == "\x02", F.lit("-")).otherwise(F.col("r"))
    t = chars.withColumn("r", r).where(F.col("r").rlike(T.GLYPH_SPACE) | ~F.col("r").rlike(r"[\x{00}-\x{1F}]"))
    t = t.withColumn("_space", F.col("r").rlike(T.GLYPH_SPACE))
    last = F.last(F.when(~F.col("_space"), F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.max(F.when(F.col("_space"), F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumns({"_last": last, "_gap": gap})
    return t.withColumn("space_before", F.coalesce(F.col("_gap") > F.coalesce("_last", F.lit(-1)), F.lit(False))).where(~F.col("_space")).drop("_space", "_last", "_gap")


def body_size(glyphs: DataFrame, top: float, bottom: float) -> DataFrame:
    """The most frequent size of each document's body, in hundredths of a point; the larger of ties."""
    return mode(glyphs.where(kept(top=top, bottom=bottom) & (F.col("size") > 0)), ["doc"], F.round(F.col("size") * 100).cast("long"), "size")


# ---- lines of one page ----


@dataclass
class Line:
    glyphs: list[dict] = field(default_factory=list)
    top: float = -math.inf
    bottom: float = math.inf

    @property
    def center(self) -> float:
        return (self.top + self.bottom) / 2

    def add(self, g: dict) -> None:
        self.glyphs.append(g)
        self.top, self.bottom = max(self.top, g["top"]), min(self.bottom, g["bottom"])

    def takes(self, g: dict) -> bool:
        """Enough overlap, or a flat glyph such as a dash near the line."""
        high, own = self.top - self.bottom, g["top"] - g["bottom"]
        overlap = min(self.top, g["top"]) - max(self.bottom, g["bottom"])
        return overlap > OVERLAP * min(high, own) or (own < FLAT * high and overlap > NEAR_FLAT * high)


def _in(r: str, ranges) -> bool:
    c = ord(r)
    return any(a <= c <= b for a, b in ranges)


def columns(r: str) -> int:
    return 2 if _in(r, WIDE) else 1


def lines_of(glyphs: list[dict]) -> list[Line]:
    """From the top down; a glyph joins one of the last three lines or begins another."""
    out: list[Line] = []
    for g in sorted(glyphs, key=lambda g: -g["top"]):
        home = next((x for x in reversed(out[-3:]) if x.takes(g)), None)
        if home is None:
            out.append(home := Line())
        home.add(g)
    for x in out:
        x.glyphs.sort(key=lambda g: g["left"])
    return out


def _upper(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def _steps(line: Line):
    return [(a, b, b["left"] - a["left"]) for a, b in zip(line.glyphs, line.glyphs[1:])]  # noqa: B905


def page_unit(lines: list[Line]) -> float:
    """The width of a narrow column: half the usual step between wide characters, or the usual step of any."""
    steps = [(a, b, d) for x in lines for a, b, d in _steps(x) if 0.5 < d <= 40]
    wide = [d for a, b, d in steps if columns(a["r"]) == columns(b["r"]) == 2]
    if len(wide) >= PAGE_STEPS:
        return _upper(wide) / 2
    unit = _upper([d for *_, d in steps]) if steps else COLUMN
    return unit if unit >= 1 else COLUMN


def line_unit(line: Line, unit: float) -> float:
    wide = [d for a, b, d in _steps(line) if columns(a["r"]) == columns(b["r"]) == 2 and 0.5 < d < 40]
    if len(wide) >= LINE_STEPS:
        return _upper(wide) / 2
    return max(unit, LEAST_UNIT * max(g["top"] - g["bottom"] for g in line.glyphs))


def words_of(line: Line, unit: float) -> list[list[dict]]:
    out = [[line.glyphs[0]]]
    for a, b, d in _steps(line):
        gap = d - max(columns(a["r"]) * unit, a["right"] - a["left"]) > GAP * unit and not (_in(a["r"], PUNCTUATION) or _in(b["r"], PUNCTUATION))
        if b.get("space_before") or gap:
            out.append([b])
        else:
            out[-1].append(b)
    return out


def flow(line: Line, unit: float) -> str:
    return " ".join("".join(g["r"] for g in w) for w in words_of(line, unit)).rstrip(" ")


def _round(x: float) -> int:
    return math.floor(x + 0.5) if x >= 0 else math.ceil(x - 0.5)


def _starts(lines: list[Line], origin: float, unit: float) -> list[int]:
    """First columns. Lines that begin within half a column of each other share one."""
    seen: dict[int, int] = {}
    out = []
    for x in lines:
        at = x.glyphs[0]["left"] - origin
        key, col = _round(at / (unit / 2)), _round(at / unit)
        if key not in seen:
            seen[key] = next((seen[k] for k in (key - 1, key + 1) if k in seen and abs(seen[k] - col) <= 1), col)
        out.append(seen[key])
    return out


def _on_grid(line: Line, origin: float, unit: float, own: float, start: int) -> str:
    out, at, end = " " * start, start, 0.0
    for i, word in enumerate(words_of(line, own)):
        if i:
            near = word[0]["left"] - end <= own * CLOSE
            pad = 1 if near else max(_round((word[0]["left"] - origin) / unit), at + 1) - at
            out, at = out + " " * pad, at + pad
        out += "".join(g["r"] for g in word)
        at += sum(columns(g["r"]) for g in word)
        end = word[-1]["right"]
    return out.rstrip(" ")


def _blank(gap: float, spacing: float) -> int:
    return 0 if spacing <= 0 else 2 if gap / spacing >= 2.2 else 1 if gap / spacing >= 1.35 else 0


def _is_bullet(s: str) -> bool:
    return bool(s) and s[0] in T.BULLETS and not (s[0] == "※" and s[1:].strip()[:1].isdigit())


def _bullet_ends(lines: list[Line], i: int, unit: float) -> bool:
    """Does the text that follows a bullet's lines begin a paragraph of its own: outdented, or further down than the bullets were apart?"""
    bullet = lambda j: _is_bullet(flow(lines[j], line_unit(lines[j], unit)))
    if i < 1 or bullet(i) or not bullet(i - 1):
        return False
    if lines[i].glyphs[0]["left"] < lines[i - 1].glyphs[0]["left"] - unit / 2:
        return True
    first = i - 1
    while first and bullet(first - 1):
        first -= 1
    return i - first >= 2 and _blank(lines[i - 1].center - lines[i].center, (lines[first].center - lines[i - 1].center) / (i - first - 1)) > 0


def render(glyphs: list[dict], grid: bool = True) -> str:
    """A page's text: on a grid of columns, or flowing; vertical gaps become blank lines."""
    if not glyphs:
        return ""
    lines = lines_of(glyphs)
    unit, origin = page_unit(lines), min(g["left"] for g in glyphs)
    gaps = [a.center - b.center for a, b in zip(lines, lines[1:]) if a.center > b.center]  # noqa: B905
    spacing = _upper(gaps) if gaps else 0.0
    out = []
    for i, (x, start) in enumerate(zip(lines, _starts(lines, origin, unit), strict=True)):
        n = _blank(lines[i - 1].center - x.center, spacing) if i else 0
        if grid and _bullet_ends(lines, i, unit):
            n = max(n, 2)
        own = line_unit(x, unit)
        out += [""] * n + [_on_grid(x, origin, unit, own, start) if grid else flow(x, own)]
    return "\n".join(out) + "\n"


def split_columns(glyphs: list[dict], width: float, left: float, right: float) -> tuple[list[dict], list[dict]]:
    """Glyphs of the two columns, none lost and none twice. One in neither column, or both, goes with the nearest of its line, or else by its centre.

    left and right: what is cut from the right for the left column, and from the left for the right one.
    """

    def side(g: dict) -> int | None:
        x = (g["left"] + g["right"]) / 2
        a, b = not (left > 0 and x > width - left), not (right > 0 and x < right)
        return None if a == b else (0 if a else 1)

    out: tuple[list, list] = ([], [])
    for line in lines_of(glyphs):
        placed = [(side(g), g) for g in line.glyphs]
        sure = [(s, g) for s, g in placed if s is not None]
        for s, g in placed:
            if s is None:
                if sure:
                    s = min(sure, key=lambda o: max(0.0, o[1]["left"] - g["right"], g["left"] - o[1]["right"]))[0]  # noqa: B023
                else:
                    s = 0 if (g["left"] + g["right"]) / 2 < (width - left + right) / 2 else 1
            out[s].append(g)
    return out


# ---- DataFrames ----

_PAGE = ["doc", "page"]


def page_text(glyphs: DataFrame, grid: bool = True) -> DataFrame:
    """Rows (doc, page, text)."""
    return grouped(glyphs, _PAGE, lambda g: [{"doc": g[0]["doc"], "page": g[0]["page"], "text": render(sorted(g, key=lambda x: x["seq"]), grid)}], "doc string, page int, text string")


def two_column_text(glyphs: DataFrame, left: float, right: float) -> DataFrame:
    """Rows (doc, page, left_text, right_text, full_text, glyphs)."""

    def of(g: list[dict]) -> list[dict]:
        g = sorted(g, key=lambda x: x["seq"])
        a, b = split_columns(g, g[0]["width"], left, right)
        return [{"doc": g[0]["doc"], "page": g[0]["page"], "left_text": render(a), "right_text": render(b), "full_text": render(g), "glyphs": len(g)}]

    return grouped(glyphs, _PAGE, of, "doc string, page int, left_text string, right_text string, full_text string, glyphs int")


def command_pages(glyphs: DataFrame, profile: dict) -> DataFrame:
    """Lines of a command book's pages: rows (doc, page, line_no, line). A page is read in columns where the columns hold what the page does, else in full width."""
    body = glyphs.where(kept(top=profile["marginTop"], bottom=profile["marginBottom"]))
    t = two_column_text(body, profile["gutterLeft"], profile["gutterRight"])
    two = T.columns_match(F.col("left_text"), F.col("right_text"), F.col("glyphs")) if profile["columns"] >= 2 else F.lit(False)
    lines = F.when(two, F.concat(T.trimmed_lines(F.col("left_text")), T.trimmed_lines(F.col("right_text")))).otherwise(T.trimmed_lines(F.col("full_text")))
    return t.select("doc", "page", F.posexplode(lines).alias("p", "line")).select("doc", "page", (F.col("p") + 1).alias("line_no"), "line")


def heading_lines(glyphs: DataFrame, size: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows (doc, page, key) of lines that look like numbered headings and whose first digit is larger than the body and `least`."""
    def of(g: list[dict]) -> list[dict]:
        lines = lines_of(sorted(g, key=lambda x: x["seq"]))
        unit, out = page_unit(lines), []
        for x in lines:
            s = flow(x, line_unit(x, unit))
            digit = next((k for k in x.glyphs if k["r"] in "0123456789０１２３４５６７８９"), None)
            if HEADING.match(s) and not LEADER.search(s) and digit and digit["body"] > 0 and digit["size"] > digit["body"] * 1.02 and digit["size"] >= least:
                out.append({"doc": g[0]["doc"], "page": g[0]["page"], "key": "".join(s.split())})
        return out

    t = glyphs.join(size.select("doc", (F.col("size") / 100).alias("body")), "doc")
    return grouped(t, _PAGE, of, "doc string, page int, key string")
