"""Queries on pages, glyphs, tables, outputs and redaction. Those without SQL need a parser or an ordered fold and are tested against known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import calibrate, layout, output, redact, ruled, sections
from quire.operators import html as H
from quire.plans.relations import Relation, table
from quire.plans.text_queries import WS

SITE = [
    ("a.html", '<ol><li class="breadcrumb-item"><span class="section-number">1. </span>基本</li></ol><div itemprop="articleBody"><section id="s"><h1><span class="section-number">1.1. </span>経路<a class="headerlink" href="#s">¶</a></h1><section id="x"><span id="route"></span><h2>ip route</h2><dl><dt>[入力形式]</dt><dd><div class="line-block"><div class="line">ip route <code>NET</code></div><div class="line-block"><div class="line">[ <b>distance</b> ]</div></div><div class="line">no ip route</div></div></dd><dt>説明</dt><dd><p>経路を設定する。</p><ul><li>一つ<ul><li>内</li></ul></li></ul></dd></dl></section></section></div>'),
    ("b/c.html", '<div itemprop="articleBody"><section id="t"><h1><span class="section-number">2. </span>表</h1><p>前書き。</p><table><tr><th rowspan="2">名</th><th colspan="2">値</th></tr><tr><td>a</td><td><p>b</p><p>c</p></td></tr></table><figure><img src="img/f.svg"><figcaption>図 1</figcaption></figure><section id="u"><h2><span class="section-number">2.1. </span>例</h2><pre>show ip\n  x  </pre></section><section id="v"><h2>番号なし</h2><p>落ちる</p></section></section></div>'),
    ("index.html", '<div itemprop="articleBody"><p>表紙</p><section id="w"><h1>はじめに</h1><p>本文</p></section></div>'),
    ("no.html", "<p>no article</p>"),
]


def _site(spark):
    return H.read_pages(spark.createDataFrame(SITE, "path string, html string"), unnumbered=True)


def site_pages(spark, sf):
    """Pages of a book with their numbers and chapters."""
    return _site(spark).select("path", F.array_join("number", ".").alias("number"), "title", "chapter_title", "unnumbered")


def site_entries(spark, sf):
    """Commands of the book's entries."""
    e = H.entries(_site(spark), ["入力形式", "説明"])
    return e.select("path", "ord", "title", "section", "anchor", "chapter", "source", F.array_join("cmds", "|").alias("cmds"), F.to_json("fields").alias("fields"))


def site_headings(spark, sf):
    h = H.headings(_site(spark))
    return h.select("path", "ord", "number", "title", "depth", "chapter", "anchor", F.transform("blocks", lambda b: b["kind"]).alias("kinds"), F.to_json("blocks").alias("blocks"))


def page_prose_blocks(spark, sf):
    """Blocks of all raw pages, by kind, with the number of their lines."""
    b = H.page_blocks(table(spark, sf, "pages"), "page_id")
    return b.groupBy("page_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.size("lines")).alias("lines"))


def page_list_items(spark, sf):
    return H.list_items(table(spark, sf, "pages"), "page_id")


CELLS = Relation("table_id int, row int, cell int, colspan string, rowspan string, text string", [(1, 0, 0, "1", "2", "a"), (1, 0, 1, "2", "1", "b"), (1, 1, 0, "x", "", "c"), (1, 1, 1, "0", "1", "d"), (1, 2, 0, "3", "1", "e"), (2, 0, 0, "1", "3", "p"), (2, 0, 1, "1", "1", "q"), (2, 1, 0, "1", "2", "r"), (2, 2, 0, "1", "1", "s")])


def html_table_grid(spark, sf):
    """Cells with spans spread over all places that they cover."""
    return H.spread_cells(CELLS.df(spark), "table_id")


TABLES = Relation("id int, row int, cells array<string>", [(1, 0, ["a|b", "c\\d"]), (1, 1, ["<br>", "x\ny"]), (1, 2, ["&amp;"]), (2, 0, [" one "]), (3, 0, ["", "q", "r"]), (3, 1, [])])


def markdown_tables(spark, sf):
    rows = TABLES.df(spark).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).getField("cells").alias("rows"))
    return output.table_markdown(rows, "id")


SECTIONS = Relation("book string, chapter int, chapter_title string, section string, first_seen long", [("b", 1, "one", "A/B", 1), ("b", 1, "one", "A:B", 2), ("b", 1, "one", "a-b", 3), ("b", 2, "two", "A/B", 4), ("b", 0, "", "", 5), ("b", 12, "x?", "y" * 61, 6), ("b", 12, "x?", "y" * 62, 7)])


def section_files(spark, sf):
    return output.file_names(SECTIONS.df(spark))


PICTURES = Relation("book string, ord int, source string", [("b", 1, "img/a.svg"), ("b", 2, "other/A.svg"), ("b", 3, "img/a.svg"), ("b", 4, "x/b.png"), ("b", 5, "noext")])


def figure_file_names(spark, sf):
    return output.figure_names(PICTURES.df(spark))


def numbered_book(spark, sf):
    """Conversations as files: contents whose line numbers point at their items."""
    c = table(spark, sf, "conversations").select(F.lit("b").alias("book"), F.lit(1).alias("chapter"), F.col("conv_id").cast("string").alias("section"), F.col("turn").alias("ord"), F.concat(F.lit("## "), "role", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n")).alias("text"))
    names = c.select("book", "chapter", "section", F.concat(F.lit("f"), "section").alias("file")).distinct()
    placed = output.numbered(c, names)
    body = output.file_contents(placed)
    at = placed.join(body, ["book", "file"]).select("file", "ord", "line", F.get(F.split("content", "\n"), (F.col("line") - 1).cast("int")).alias("body"))
    return at.select("file", "ord", F.col("line").cast("long").alias("line"), F.startswith("body", F.lit("## ")).alias("points_at_heading"))


COUNTS = Relation("book string, chapter int, section string, first_seen long, n long, file string", [("b", 1, "x", 1, 2, "ch01-a/x y.md"), ("b", 2, "z", 3, 1, "ch02-b/z.md")])
READMES = Relation("book string, title string, kind string, source string, version string, items long, files long", [("b", "T", "web", "http://h.example/", "1.5a", 3, 2), ("c", "U", "pdf", "u.pdf", "", 0, 0)])


def book_guides(spark, sf):
    i = output.book_index(COUNTS.df(spark), spark.createDataFrame([("b", 1, "one")], "book string, chapter int, title string"))
    return i.select("book", "head", "line").unionByName(output.book_readme(READMES.df(spark)).select("book", F.lit("readme").alias("head"), F.col("content").alias("line")))


# ---- glyphs ----


def _glyph_rows(page: int, y: float, text: str, x: float = 50.0, step: float = 10.0, size: float = 10.0, seq: int = 0) -> list[tuple]:
    return [("d", page, seq + i, c, x + i * step, x + i * step + step * 0.9, float(y + size), float(y), float(size), text[i - 1 : i] == " ", 516.0, 728.0) for i, c in enumerate(text) if c != " "]


GLYPHS = Relation(
    "doc string, page int, seq int, r string, left double, right double, top double, bottom double, size double, space_before boolean, width double, height double",
    [*_glyph_rows(1, 600, "２．１ 概要", size=12), *_glyph_rows(1, 580, "本文の行である", seq=100), *_glyph_rows(1, 565, "続きの行", seq=200), *_glyph_rows(1, 700, "頭", seq=300), *_glyph_rows(2, 600, "abc", step=6.0, seq=0), *_glyph_rows(2, 600, "right", x=300.0, step=6.0, seq=50), *_glyph_rows(2, 585, "L2", step=6.0, seq=80)],
)


def glyph_text(spark, sf):
    """Page text on a grid of columns."""
    return layout.page_text(GLYPHS.df(spark).where(layout.kept(top=45, bottom=45)))


def glyph_columns(spark, sf):
    """Glyphs of two columns: none is lost."""
    t = layout.two_column_text(GLYPHS.df(spark), 256, 262)
    n = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    return t.select("doc", "page", "left_text", "right_text", (n("left_text") + n("right_text") == F.col("glyphs")).alias("all_there"))


def glyph_headings(spark, sf):
    """Large numbered lines."""
    g = GLYPHS.df(spark)
    return layout.heading_lines(g.where(layout.kept(top=45, bottom=45)), layout.body_size(g, 45, 45), 0)


def glyph_body_size(spark, sf):
    return layout.body_size(GLYPHS.df(spark), 45, 45)


def glyphs_outside(spark, sf):
    t = spark.createDataFrame([("d", 1, 60.0, 100.0, 620.0, 560.0)], "doc string, page int, t_left double, t_right double, t_top double, t_bottom double")
    return layout.outside(GLYPHS.df(spark), t).select("doc", "page", "seq", "r")


CHARS = Relation("doc string, page int, seq int, r string", [("d", 1, i, c) for i, c in enumerate("a b　 c\x02d\x01e  f")] + [("d", 2, 0, " "), ("d", 2, 1, "x")])


def glyph_spaces(spark, sf):
    return layout.folded_spaces(CHARS.df(spark))


def calibration(spark, sf):
    """The top margin at which running heads are gone, and whether there is text at all."""
    g = GLYPHS.df(spark)
    m = calibrate.running_band(g, 728).select(F.lit("margin").alias("what"), F.col("margin").cast("long").alias("v"))
    n = calibrate.text_layer(g).select(F.lit("glyphs").alias("what"), F.col("glyphs").alias("v"))
    return m.unionByName(n)


GUTTER = Relation("page int, lo double, hi double, top double, bottom double", [(p, x, x + 8.0, 700.0 - y, 690.0 - y) for p in range(1, 12) for y in range(0, 200, 10) for x in (20.0, 30.0, 40.0, 60.0, 70.0, 80.0)])


def calibration_gutter(spark, sf):
    return calibrate.gutter(GUTTER.df(spark), 11, 0, 100)


FULL = Relation("page int, n int", [(p, 301 if p % 5 else 10) for p in range(1, 101)])


def calibration_samples(spark, sf):
    g = FULL.df(spark).select("page", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return calibrate.sample_pages(g, 4, 3).select(F.col("window").cast("int").alias("window"), "first", "last")


def _rules(page: int, xs=(0.0, 50.0, 100.0, 150.0), ys=(100.0, 80.0, 60.0, 40.0)) -> list[tuple]:
    return [("d", page, True, x, ys[-1], ys[0]) for x in xs] + [("d", page, False, y, xs[0], xs[-1]) for y in ys]


RULES = Relation("doc string, page int, vertical boolean, pos double, lo double, hi double", [*_rules(1), ("d", 1, False, 100.4, 20.0, 60.0), *_rules(2)])
_CELL_TEXT = {1: (("K", "V", "W"), ("a", "1", "x"), ("a", "2", "y")), 2: (("a", "3", "z"), ("a", "4", ""), ("a", "5", "q"))}
CELL_GLYPHS = [("d", p, r * 10 + c, t, 50.0 * c + 10, 50.0 * c + 16, 95.0 - 20 * r, 85.0 - 20 * r, 8.0, False, 516.0, 728.0) for p, rows in _CELL_TEXT.items() for r, row in enumerate(rows) for c, t in enumerate(row) if t]


def _cells(spark):
    return spark.createDataFrame(CELL_GLYPHS, GLYPHS.schema)


def ruled_table_cells(spark, sf):
    """Tables out of rules and glyphs, a row a cell."""
    t = ruled.page_tables(_cells(spark), RULES.df(spark))
    t = t.select("doc", "page", "ord", F.posexplode("rows").alias("row", "cells"))
    return t.select("doc", "page", "ord", "row", F.posexplode("cells").alias("col", "text"))


def carried_headers(spark, sf):
    """Headers carried over a page end."""
    t = ruled.page_tables(_cells(spark), RULES.df(spark)).withColumns({"section": F.lit("s"), "nothing_below": F.lit(True), "nothing_above": F.lit(True)})
    return ruled.carried(t).select("doc", "page", "header_page", "header_rows", F.to_json("rows").alias("rows"))


FOLD = Relation(
    "doc string, page int, line_no int, line string, chapter int, section string",
    [("d", p, i, x, 2, "s") for p, i, x in [(1, 1, "front"), (1, 2, "2.1 概要"), (1, 3, "本文です。"), (1, 4, "a     b"), (1, 5, ""), (1, 6, "c     d"), (1, 7, ""), (1, 8, ""), (1, 9, "one    line"), (2, 1, "2.2 設定 ......................"), (2, 2, "3.1 other chapter"), (2, 3, "２．２ 設定"), (2, 4, "この行は二十二文字より長い日本語の文なので地の文になるはずである")]],
)


def section_fold(spark, sf):
    """Headings of page lines, with their blocks."""
    return sections.headings(FOLD.df(spark)).select("doc", "ord", "number", "title", "depth", "page", F.to_json("blocks").alias("blocks"))


def scan_halves(spark, sf):
    """Gray spreads cut at a white middle."""
    w, h = 40, 40
    rows = [("white", w, h, [255] * (w * h)), ("dark", w, h, [255 if x != 20 else 0 for _ in range(h) for x in range(w)])]
    return ruled.split_scans(spark.createDataFrame(rows, "name string, w int, h int, pix array<int>")).select("name", "part", "w", "h")


LINES = Relation("id int, line string", list(enumerate(["username bob password plain hunter22", "no ike preshared-key abc", "usern x pass", "hostname r1", "copy http://u:p@192.0.2.1/x flash", "utm license key netmeister", "pki cert import pem name n", "pki cert import pem name n url http://192.0.2.1/c", "snmp-agent community public", "radius host 192.0.2.1 key 1 sekret"])))


def protected_config(spark, sf):
    return redact.protected_lines(LINES.df(spark))


SESSIONS = Relation("session string, seq int, line string, output string", [("a", 1, "username bob password plain hunter22", "% Invalid 'hunter22' near hun\nter22"), ("a", 2, "ip route x", "password was hunt... and \\x68unter22"), ("b", 1, "hostname r1", "fine 'quoted'"), ("b", 2, "pki private-key export k", "MIIB")])


def redact_transcript(spark, sf):
    return redact.redacted(SESSIONS.df(spark))


QUERIES = {
    f.__name__: f
    for f in (site_pages, site_entries, site_headings, page_prose_blocks, page_list_items, html_table_grid, markdown_tables, section_files, figure_file_names, numbered_book, book_guides, glyph_text, glyph_columns, glyph_headings, glyph_body_size, glyphs_outside, glyph_spaces, calibration, calibration_gutter, calibration_samples, ruled_table_cells, carried_headers, section_fold, scan_halves, protected_config, redact_transcript)
}

_CELL = "replace(replace(replace(replace(replace(replace(trim(c, ' '), '\\', '\\\\'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), chr(10), '<br>')"
_SAFE = """case when regexp_replace(trim(s), '[<>:"/\\\\|?*]', '-', 'g') = '' then '無題' else substr(regexp_replace(trim(s), '[<>:"/\\\\|?*]', '-', 'g'), 1, 60) end"""
_X, _Y = '("left" + "right") / 2', "(top + bottom) / 2"

_SITE = Relation("path string, html string", SITE)

ORACLE_SQL = {
    "site_pages": f"""with p as (select path, html, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) h from {_SITE.sql()} where contains(html, 'articleBody')),
n as (select *, regexp_extract(h, 'section-number">([0-9.]*)\\. <', 1) number, trim(regexp_replace(regexp_replace(h, '<span class="section-number">.*?</span>|<a class="headerlink".*?</a>', '', 'g'), '<[^>]*>', '', 'g')) title,
 regexp_extract(html, 'breadcrumb-item"><span class="section-number">([0-9]+)\\. </span>', 1) bn, regexp_extract(html, 'breadcrumb-item"><span class="section-number">[0-9]+\\. </span>([^<]*)<', 1) bt from p),
m as (select max(try_cast(split_part(number, '.', 1) as int)) m from n), r as (select path, row_number() over (order by string_split(path, '/')) k from n where number = '')
select path, case when number = '' then (m + k)::varchar else number end number, title, case when number <> '' and bn = split_part(number, '.', 1) then bt else title end chapter_title, number = '' unnumbered from n cross join m left join r using (path)""",
    "html_table_grid": f"""with recursive c as (select table_id, "row" r, greatest(coalesce(try_cast(colspan as int), 1), 1) w, greatest(coalesce(try_cast(rowspan as int), 1), 1) h, text, row_number() over (partition by table_id order by "row", cell) k, max("row") over (partition by table_id) last from {CELLS.sql()}),
s as (select table_id, 0::bigint k, -1 r, 0 col, []::struct(r int, c int, text varchar)[] held from (select distinct table_id from c)
 union all select table_id, k, r, p + w, list_concat(held, list_transform(range(w * h), lambda i: {{'r': (r + i // w)::int, 'c': (p + i % w)::int, 'text': text}}))
 from (select c.*, s.held, list_min(list_filter(range(20), lambda x: x >= (case when s.r = c.r then s.col else 0 end) and not list_contains(list_transform(s.held, lambda t: t.r * 100 + t.c), c.r * 100 + x)))::int p from s join c on c.table_id = s.table_id and c.k = s.k + 1)),
f as (select table_id, arg_max(held, k) held from s group by table_id), u as (select table_id, unnest(held) t from f) select u.table_id, t.r as "row", t.c as col, t.text as text from u join (select distinct table_id, last from c) l on l.table_id = u.table_id where t.r <= last""",
    "scan_halves": """with px as (select name, x, y, case when name = 'dark' and x = 20 then 0 else 255 end v from (values ('white'), ('dark')) n(name), range(40) a(x), range(40) b(y)),
w as (select name, bool_and(v >= 250) filter (x between 4 and 36 and y between 2 and 37) spread, count(*) filter (y between 2 and 37) // count(distinct x) h, count(distinct x) w from px group by name)
select name, part::int part, (case when spread then w // 2 else w end)::int w, h::int h from (select *, unnest(generate_series(1, case when spread then 2 else 1 end)) part from w)""",
    "ruled_table_cells": f"""with r as (select *, pos - lag(pos) over (partition by page, vertical order by pos) d from {RULES.sql()}), k as (select *, sum(case when d <= 1 then 0 else 1 end) over (partition by page, vertical order by pos rows unbounded preceding) c from r),
a as (select page, vertical, c, (min(pos) + max(pos)) / 2 p from k group by all), x as (select page, p, row_number() over (partition by page order by p) - 1 i, lead(p) over (partition by page order by p) q from a where vertical), y as (select page, p, row_number() over (partition by page order by p desc) - 1 i, lead(p) over (partition by page order by p desc) q from a where not vertical),
g as (select * from {Relation(GLYPHS.schema, CELL_GLYPHS).sql()}) select 'd' doc, x.page, 0 ord, y.i::int "row", x.i::int col, coalesce(string_agg(g.r, '' order by g."left"), '') text from x join y on x.page = y.page left join g on g.page = x.page and (g."left" + g."right") / 2 between x.p and x.q and (g.top + g.bottom) / 2 between y.q and y.p where x.q is not null and y.q is not null group by all""",
    "page_list_items": """with n as (select page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1) l from pages),
i as (select page_id, unnest(l) x, generate_subscripts(l, 1) - 1 ord from n) select page_id, ord::int ord, trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) item from i""",
    "markdown_tables": f"""with t as (select * from {TABLES.sql()}), w as (select id, max(len(cells)) w from t group by id), p as (select t.id, "row", w, unnest(generate_series(1, w)) i, cells from t join w using (id)),
c as (select id, "row", w, i, coalesce(cells[i], '') c from p), l as (select id, "row", w, '|' || string_agg(' ' || {_CELL} || ' |', '' order by i) line from c group by all),
a as (select id, "row" * 2 k, line from l union all select id, 1, '|' || repeat('---|', w::int) from w) select id, string_agg(line, chr(10) order by k) || chr(10) markdown from a group by id""",
    "section_files": f"""with t as (select *, case when chapter > 0 then 'ch' || lpad(chapter::varchar, 2, '0') || '-' || {_SAFE.replace('(s)', '(chapter_title)')} else 'ch00-その他' end || '/' || {_SAFE.replace('(s)', '("section")')} stem from {SECTIONS.sql()}),
n as (select *, row_number() over (partition by book, lower(stem) order by first_seen) k from t) select book, chapter, "section", first_seen, stem || case when k > 1 then '-' || k else '' end || '.md' file from n""",
    "figure_file_names": f"""with t as (select book, source, min(ord) o from {PICTURES.sql()} group by all), b as (select *, regexp_extract(source, '[^/]*$') base from t), n as (select *, row_number() over (partition by book, lower(base) order by o) k from b)
select book, source, case when k = 1 then base else regexp_replace(base, '\\.[^.]*$', '') || '-' || k || regexp_extract(base, '\\.[^.]*$') end as name from n""",
    "numbered_book": """with t as (select conv_id, turn, '## ' || role || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) body from conversations)
select 'f' || conv_id file, turn ord, (3 + coalesce(sum(length(body) - length(replace(body, chr(10), ''))) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint line, true points_at_heading from t""",
    "book_guides": f"""select book, '## ' || chapter || '. ' || case chapter when 1 then 'one' else '' end head, '- [' || "section" || '](' || case when regexp_matches(file, '[ ()]') then '<' || file || '>' else file end || ') — ' || n line from {COUNTS.sql()}
union all select book, 'readme', '# ' || title || chr(10) || chr(10) || '- source: ' || source || case when kind = 'web' then ' (web)' else '' end || chr(10) || case when version <> '' then '- version: ' || version || chr(10) else '' end || '- items: ' || items || ', files: ' || files || chr(10) from {READMES.sql()}""",
    "glyph_body_size": f"with c as (select doc, round(size * 100)::bigint size, count(*) n from {GLYPHS.sql()} where {_Y} <= height - 45 and {_Y} >= 45 and size > 0 group by all), r as (select *, row_number() over (partition by doc order by n desc, size desc) k from c) select doc, size, n from r where k = 1",
    "glyphs_outside": f"select doc, page, seq, r from {GLYPHS.sql()} where not (doc = 'd' and page = 1 and {_X} between 60 and 100 and {_Y} between 560 and 620)",
    "glyph_spaces": """with t as (select doc, page, seq, case when r = chr(2) then '-' else r end r, regexp_matches(case when r = chr(2) then '-' else r end, '[\\t-\\r \\x{00}\\x{A0}\\x{3000}\\x{FEFF}]') s from CHARS),
k as (select * from t where s or not regexp_matches(r, '[\\x{00}-\\x{1F}]')), g as (select *, max(case when s then seq end) over w gap, max(case when not s then seq end) over w prior from k window w as (partition by doc, page order by seq rows between unbounded preceding and 1 preceding))
select doc, page, seq, r, coalesce(gap > coalesce(prior, -1), false) space_before from g where not s""".replace("CHARS", CHARS.sql()),
    "calibration": f"""with g as (select (floor((728 - {_Y}) / 2) * 2 + 2)::int m from {GLYPHS.sql()}), c as (select unnest(generate_series(2, 182, 2)) m), l as (select c.m, count(g.m) lost from c left join g on g.m = c.m group by c.m),
s as (select m, sum(lost) over (order by m) gone from l), p as (select m, gone, lag(gone) over (order by m) before from s) select 'margin' what, min(m)::bigint v from p where gone > 0 and gone = before union all select 'glyphs', count(*) from {GLYPHS.sql()} where page <= 20""",
    "calibration_gutter": f"""with t as (select * from {GUTTER.sql()}), u as (select distinct page, unnest(generate_series(floor(lo)::int, ceil(hi)::int)) x from t), c as (select x, count(*) n from u group by x), a as (select unnest(generate_series(25, 75)) x),
e as (select a.x from a left join c using (x) where coalesce(n, 0) <= 1), g as (select x, x - row_number() over (order by x) g from e), r as (select min(x) a, max(x) b, count(*) n from g group by g), b as (select (a + b) / 2 middle from r where n >= 2 order by n desc, a limit 1)
select middle, count(*) filter (hi <= middle + 3) as "left", count(*) filter (lo >= middle - 3) as "right", count(*) as "all" from t, b group by middle""",
    "calibration_samples": f"""with f as (select page, row_number() over (order by page) - 1 i, count(*) over () n from {FULL.sql()} where n > 300), p as (select *, floor(n * 0.15) lo, ceil(n * 0.85) hi from f), s as (select *, greatest(1, floor((hi - lo) / 4)) st from p),
k as (select ((i - lo) / st)::int as "window", page from s where i >= lo and i < hi and (i - lo) % st = 0), l as (select *, lag(page) over (order by page) before from k where "window" < 4) select "window", page as first, page + 2 as last from l where before is null or page > before + 2""",
}
