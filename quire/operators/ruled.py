"""Tables out of ruled lines: rows (doc, page, vertical, pos, lo, hi) with a page's glyphs. A page's rules are a bounded group."""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import layout
from quire.operators.arrow import grouped

#: Points within which rules count as touching; fewest cells, smallest size, most cells of a table.
NEAR, CELLS, SMALLEST, MOST = 1.0, 4, (24.0, 16.0), 20_000


def merge(rules: list[tuple]) -> list[tuple]:
    """(vertical, pos, lo, hi): rules within NEAR of the first of their cluster lie on one line; touching intervals of a line are one."""
    out: list[tuple] = []
    for vertical in (False, True):
        left = sorted(r for r in rules if r[0] == vertical)
        while left:
            n = bisect.bisect_right([r[1] for r in left], left[0][1] + NEAR)
            cluster, left = left[:n], left[n:]
            pos = (cluster[0][1] + cluster[-1][1]) / 2
            spans: list[list[float]] = []
            for _, _, lo, hi in sorted(cluster, key=lambda r: r[2]):
                if spans and lo <= spans[-1][1] + NEAR:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            out += [(vertical, pos, lo, hi) for lo, hi in spans]
    return out


class Sets:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        self.up[self.root(a)] = self.root(b)


def connected(rules: list[tuple]) -> list[list[tuple]]:
    """Rules that cross or touch, horizontal with vertical, by groups."""
    if not rules:
        return []
    v = np.array([r[0] for r in rules])
    pos, lo, hi = (np.array([r[k] for r in rules]) for k in (1, 2, 3))
    meets = (v[:, None] != v) & (pos[:, None] >= lo - NEAR) & (pos[:, None] <= hi + NEAR)
    sets = Sets(len(rules))
    for a, b in zip(*np.nonzero(meets & meets.T), strict=True):
        sets.join(int(a), int(b))
    groups: dict[int, list[tuple]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(sets.root(i), []).append(r)
    return list(groups.values())


def axis(positions: list[float]) -> list[float]:
    out: list[float] = []
    for x in sorted(positions):
        if not out or x - out[-1] > NEAR:
            out.append(x)
    return out


class Grid:
    """The cells that one group of rules makes. ValueError where the rules leave a doubt."""

    def __init__(self, rules: list[tuple]):
        self.rules = rules
        self.xs = axis([r[1] for r in rules if r[0]])
        self.ys = axis([r[1] for r in rules if not r[0]])[::-1]
        self.rows, self.cols = len(self.ys) - 1, len(self.xs) - 1
        if min(self.rows, self.cols) < 2 or self.rows * self.cols > MOST or self.xs[-1] - self.xs[0] < SMALLEST[0] or self.ys[0] - self.ys[-1] < SMALLEST[1]:
            raise ValueError("no grid")
        self.closed(0, self.rows - 1, 0, self.cols - 1)
        sets = Sets(self.rows * self.cols)
        for r, c in itertools.product(range(self.rows), range(self.cols)):
            at = r * self.cols + c
            if c + 1 < self.cols and not self.edge(True, self.xs[c + 1], self.ys[r + 1], self.ys[r]):
                sets.join(at, at + 1)
            if r + 1 < self.rows and not self.edge(False, self.ys[r + 1], self.xs[c], self.xs[c + 1]):
                sets.join(at, at + self.cols)
        self.cell = np.array([sets.root(i) for i in range(self.rows * self.cols)]).reshape(self.rows, self.cols)
        self.spans: dict[int, tuple[int, int, int, int]] = {}
        for k in np.unique(self.cell).tolist():
            r, c = np.nonzero(self.cell == k)
            span = (int(r.min()), int(r.max()), int(c.min()), int(c.max()))
            if (span[1] - span[0] + 1) * (span[3] - span[2] + 1) != len(r):
                raise ValueError("a merged cell is no rectangle")
            self.closed(*span)
            self.spans[k] = span
        if len(self.spans) < CELLS:
            raise ValueError("too few cells")

    def edge(self, vertical: bool, pos: float, lo: float, hi: float) -> bool:
        """Is there a rule over the whole of it? One over a part is a doubt."""
        own = [r for r in self.rules if r[0] == vertical and abs(r[1] - pos) <= NEAR]
        if any(r[2] <= lo + NEAR and r[3] >= hi - NEAR for r in own):
            return True
        if any(min(r[3], hi) - max(r[2], lo) > NEAR for r in own):
            raise ValueError("half an edge")
        return False

    def closed(self, r0: int, r1: int, c0: int, c1: int) -> None:
        x, y = (self.xs[c0], self.xs[c1 + 1]), (self.ys[r1 + 1], self.ys[r0])
        if not (all(self.edge(True, p, *y) for p in x) and all(self.edge(False, p, *x) for p in y)):
            raise ValueError("not closed")

    def fill(self, glyphs: list[dict]) -> dict:
        """The table with the glyphs' text in its cells; a glyph across an edge is a doubt."""
        held: dict[int, list[dict]] = {}
        for g in glyphs:
            x, y = (g["left"] + g["right"]) / 2, (g["top"] + g["bottom"]) / 2
            if not (self.xs[0] <= x <= self.xs[-1] and self.ys[-1] <= y <= self.ys[0]):
                continue
            c = bisect.bisect_right(self.xs, x) - 1
            r = bisect.bisect_right([-v for v in self.ys], -y) - 1
            if not (0 <= r < self.rows and 0 <= c < self.cols):
                raise ValueError("a glyph on the border")
            k = int(self.cell[r, c])
            r0, r1, c0, c1 = self.spans[k]
            if g["left"] < self.xs[c0] - NEAR or g["right"] > self.xs[c1 + 1] + NEAR or g["top"] > self.ys[r0] + NEAR or g["bottom"] < self.ys[r1 + 1] - NEAR:
                raise ValueError("a glyph across an edge")
            held.setdefault(k, []).append(g)
        if len(held) < CELLS or 2 * len(held) < len(self.spans):
            raise ValueError("mostly empty")
        text = {k: "\n".join(x.strip() for x in layout.render(g, False).split("\n") if x.strip()) for k, g in held.items()}
        merged = [any(s[0] <= r <= s[1] and (s[1] > s[0] or s[3] > s[2]) for s in self.spans.values()) for r in range(self.rows)]
        return {"left": self.xs[0], "right": self.xs[-1], "top": self.ys[0], "bottom": self.ys[-1], "columns": self.xs, "rows": [[text.get(int(k), "") for k in row] for row in self.cell], "merged": merged, "header_rows": self.headers()}

    def headers(self) -> int:
        """Header rows: as far down as cells that begin in them reach, and one more under a cell over some of the columns."""
        n, r = 1, 0
        while r < min(n, self.rows):
            for r0, r1, c0, c1 in self.spans.values():
                if r0 == r:
                    n = max(n, r1 + 1 + (c0 < c1 and c1 - c0 + 1 < self.cols))
            r += 1
        return n


def tables_of(rules: list[tuple], glyphs: list[dict]) -> list[dict]:
    """The page's sure tables, from the top left. Of tables that overlap none is sure."""
    found = []
    for group in connected(merge(rules)):
        try:
            found.append(Grid(group).fill(glyphs))
        except ValueError:
            continue
    over = lambda a, b: min(a["right"], b["right"]) > max(a["left"], b["left"]) and min(a["top"], b["top"]) > max(a["bottom"], b["bottom"])
    return sorted((a for a in found if not any(a is not b and over(a, b) for b in found)), key=lambda t: (-t["top"], t["left"]))


_TABLE = "doc string, page int, ord int, left double, right double, top double, bottom double, columns array<double>, rows array<array<string>>, merged array<boolean>, header_rows int"


def page_tables(glyphs: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of _TABLE from the glyphs and rules of each page that has rules."""
    a = glyphs.groupBy("doc", "page").agg(F.collect_list(F.struct("seq", "r", "left", "right", "top", "bottom", "space_before")).alias("glyphs"))
    b = rules.groupBy("doc", "page").agg(F.collect_list(F.struct("vertical", "pos", "lo", "hi")).alias("rules"))
    from quire.operators.arrow import mapped

    def of(r: dict) -> list[dict]:
        got = tables_of([(x["vertical"], x["pos"], x["lo"], x["hi"]) for x in r["rules"]], sorted(r["glyphs"] or [], key=lambda g: g["seq"]))
        return [{"doc": r["doc"], "page": r["page"], "ord": i} | t for i, t in enumerate(got)]

    return mapped(b.join(a, ["doc", "page"], "left"), of, _TABLE)


def continues(before: dict, now: dict) -> bool:
    """Does the first table of a page go on with the last one of the page before? Same columns, nothing of the body between, and a column whose first values are repeated ones of the table before and none of its headers."""
    if len(before["columns"]) != len(now["columns"]) or not before["rows"] or not now["rows"] or not before["nothing_below"] or not now["nothing_above"]:
        return False
    if any(abs((a - before["left"]) - (b - now["left"])) > NEAR for a, b in zip(before["columns"], now["columns"], strict=True)):
        return False
    h = before["header_rows"]
    if not 1 <= h < len(before["rows"]) or not now["merged"] or now["merged"][0]:
        return False
    key = lambda s: "".join(s.split())
    for c in range(len(before["rows"][0])):
        heads, values = {key(r[c]) for r in before["rows"][:h]}, [key(r[c]) for r in before["rows"][h:]]
        if all((v := key(r[c])) and v not in heads and values.count(v) >= 2 for r in now["rows"][:3]):
            return True
    return False


def carried(tables: DataFrame) -> DataFrame:
    """Tables of a document in page order with the headers of the table that they go on with, over any number of pages; header_page says where they are from.

    Adds to _TABLE: section (as printed, not inherited), nothing_below, nothing_above. One document's tables are a bounded group.
    """

    def of(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        last: dict | None = None
        pages = itertools.groupby(sorted(rows, key=lambda r: (r["page"], r["ord"])), key=lambda r: r["page"])
        for page, own in pages:
            for i, t in enumerate(own):
                t = dict(t, header_page=page)
                if i == 0 and last and last["page"] == page - 1 and last["section"] == t["section"] and continues(last, t):
                    h = last["header_rows"]
                    t |= {"rows": last["rows"][:h] + t["rows"], "merged": last["merged"][:h] + t["merged"], "header_rows": h, "header_page": last["header_page"]}
                out.append(t)
                current = t
            last = current
        return [{k: r[k] for k in ("doc", "page", "ord", "rows", "header_rows", "header_page")} for r in out]

    return grouped(tables, ["doc"], of, "doc string, page int, ord int, rows array<array<string>>, header_rows int, header_page int")


# ---- rules out of pixels ----


def runs(dark: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(row, start, stop) of the runs of true values of `least` length or more."""
    padded = np.zeros((dark.shape[0], dark.shape[1] + 2), np.int8)
    padded[:, 1:-1] = dark
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    long = stop - start >= least
    return list(zip(row[long].tolist(), start[long].tolist(), stop[long].tolist(), strict=True))


def gray(rgb: np.ndarray) -> np.ndarray:
    """Rec. 601 in whole numbers."""
    x = rgb[..., :3].astype(np.uint32) * 0x101
    return ((19595 * x[..., 0] + 38470 * x[..., 1] + 7471 * x[..., 2] + (1 << 15)) >> 24).astype(np.uint8)


def image_rules(pixels: np.ndarray, width: float, height: float, dark: int = 180) -> list[tuple]:
    """Ruled lines of a gray page image: dark runs of 12 points across or 8 down."""
    sx, sy = width / pixels.shape[1], height / pixels.shape[0]
    mask = pixels < dark
    out = [(False, height - (y + 0.5) * sy, a * sx, b * sx) for y, a, b in runs(mask, math.ceil(12 / sx - 1e-9))]
    out += [(True, (x + 0.5) * sx, height - b * sy, height - a * sy) for x, a, b in runs(mask.T, math.ceil(8 / sy - 1e-9))]
    return out


# ---- scanned spreads ----


def trimmed(pixels: np.ndarray, share: float = 0.07) -> np.ndarray:
    n = int(pixels.shape[0] * share)
    return pixels[n : pixels.shape[0] - n]


def halves(pixels: np.ndarray, stripe: int = 16, white: int = 250) -> list[np.ndarray]:
    """The two pages of a spread, or the one image: it is a spread where the stripe at its middle is white throughout."""
    p = trimmed(pixels)
    mid = p.shape[1] // 2
    if (p[:, max(0, mid - stripe) : mid + stripe + 1] >= white).all():
        return [p[:, :mid], p[:, mid:]]
    return [p]


def split_scans(images: DataFrame) -> DataFrame:
    """Rows (name, w, h, pix array<int>) of gray images to one row a page: (name, part, w, h, pix)."""
    from quire.operators.arrow import mapped

    def of(r: dict) -> list[dict]:
        parts = halves(np.array(r["pix"], np.uint8).reshape(r["h"], r["w"]))
        return [{"name": r["name"], "part": i + 1, "w": p.shape[1], "h": p.shape[0], "pix": p.ravel().tolist()} for i, p in enumerate(parts)]

    return mapped(images.select("name", "w", "h", "pix"), of, "name string, part int, w int, h int, pix array<int>")
