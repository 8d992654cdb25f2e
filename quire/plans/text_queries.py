"""Queries on lines and text, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import commands as C
from quire.functions import text as T
from quire.operators import lines as L
from quire.plans.relations import DOCUMENT_LINES, Relation, table

WS = T.SPACE
_trim = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+\\z', '', 'g')"
_collapse = lambda c: _trim(f"regexp_replace({c}, '{T.FOLDED}', ' ', 'g')")
_bullet = lambda c: f"(regexp_matches({c}, '^[•・※➢‒–—*\\-]') and not regexp_matches({c}, '^※{WS}*[0-9]'))"
_ends = lambda c: f"regexp_matches({c}, '[。！？!?]{WS}*\\z')"
_lines = "select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents where text is not null"

LINES = Relation(
    "id int, line string",
    [
        (1, "　"), (2, "• bullet text"), (3, "※1 システム全体で 1000 まで"), (4, "※ 注意"), (5, "終わりです。"), (6, "name    value   unit"), (7, "show running-config"), (8, "短い日本語の行"),
        (9, "この行は二十二文字より長い日本語の文なので地の文になるはずである"), (10, "Why!"), (11, ""), (12, "\t tab "), (13, "  二段  三段   の表"), (14, "- dash"), (15, "ｶﾅの半角が混ざる十分に長い行であることを確かめるための文字列"), (16, "NAME．．．説明"), (17, "1.5a 版"),
    ],
)


def collapse_text(spark, sf):
    """White space folded in every document."""
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("digest"), F.length(T.collapse(F.col("text"))).cast("long").alias("n"))


def _line_source(spark, sf):
    own = L.exploded(table(spark, sf, "documents"), "doc_id").select("line")
    return own.unionByName(LINES.df(spark).select("line"))


def line_kind_counts(spark, sf):
    """Lines by the rule that classifies them."""
    t = _line_source(spark, sf).withColumn("t", T.trim(F.col("line"))).select(T.line_rule(F.col("line"), F.col("t")).alias("rule"))
    return t.groupBy("rule").agg(F.count("*").alias("n")).select("rule", T.line_kind(F.col("rule")).alias("kind"), "n")


_GAP = "coalesce(list_max(list_transform(regexp_extract_all(trim(line, ' '), ' +'), lambda x: length(x))), 0)"
_RULE = f"""case when {_trim('line')} = '' then 'blank' when {_bullet(_trim('line'))} then 'bullet' when {_ends(_trim('line'))} then 'sentence'
 when {_GAP} >= 3 then 'gap' when not regexp_matches({_trim('line')}, '{T.JAPANESE}') then 'foreign' when length({_trim('line')}) < 22 then 'short' else 'long' end"""


def interior_gap_max(spark, sf):
    """The widest inner gap of each document's lines."""
    t = L.exploded(table(spark, sf, "documents"), "doc_id").select("doc_id", T.interior_gap(F.col("line")).alias("gap"))
    return t.groupBy("doc_id").agg(F.max("gap").cast("long").alias("gap"))


def logical_lines(spark, sf):
    """Wrapped lines of all documents joined; their number, and a digest of the joined text."""
    t = L.logical_lines(L.exploded(table(spark, sf, "documents"), "doc_id"), ["doc_id"])
    return t.groupBy("doc_id").agg(F.count("*").alias("units"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("unit", "text"))).getField("text"), "\n"), 256).alias("digest"))


WRAPPED = Relation(
    "doc string, line_no int, line string",
    [
        ("a", 1, "最大レ"), ("a", 2, "コード数は"), ("a", 3, "abc"), ("a", 4, "def である。"), ("a", 5, "次の文"), ("a", 6, ""), ("a", 7, "NAME．．．引数"), ("a", 8, "の説明"), ("a", 9, "• 補足 one"), ("a", 10, "two"), ("a", 11, "※1 脚注"),
        ("b", 1, ""), ("b", 2, "  indented"), ("b", 3, "word"), ("b", 4, "end!"), ("b", 5, ""), ("b", 6, ""), ("b", 7, "last"), ("b", 8, "・項目"), ("b", 9, "地の文。"), ("b", 10, "<VLAN 番号>:<port> を書く"),
    ], ("lines", ["concat('d', doc_id)", "cast(line_no as int)", "line"], f"select 'd' || doc_id, line_no::int, line from ({DOCUMENT_LINES})"))


def logical_lines_japanese(spark, sf):
    return L.logical_lines(WRAPPED.df(spark, sf), ["doc"]).select("doc", F.col("unit").cast("long").alias("unit"), "text")


def _units(source: str, key: str) -> str:
    return f"""
with l as ({source}), t as (select *, {_trim('line')} tt from l),
b as (select *, coalesce(lag(tt) over (partition by {key} order by line_no), '') before from t),
o as (select *, tt <> '' and (before = '' or {_bullet('tt')} or contains(tt, '．．．') or {_ends('before')}) opens from b),
u as (select *, sum(opens::int) over (partition by {key} order by line_no) unit from o),
p as (select {key}, unit, line_no, case when opens then tt when regexp_matches(before, '[A-Za-z0-9]\\z') and regexp_matches(tt, '^[A-Za-z0-9]') then ' ' || tt else tt end piece from u where tt <> ''),
r as (select {key}, unit::bigint unit, string_agg(piece, '' order by line_no) text from p group by all)"""


def render_body_state(spark, sf):
    """Joined lines as Markdown lists and prose."""
    units = L.logical_lines(WRAPPED.df(spark, sf), ["doc"])
    return L.rendered_body(units, ["doc"]).select("doc", F.col("unit").cast("long").alias("unit"), "out")


_RENDER = (
    _units(f"select * from {WRAPPED.sql()}", "doc")
    + f""", k as (select *, case when contains(text, '．．．') then 'p' when {_bullet('text')} then 'b' else 't' end k from r),
s as (select *, coalesce(lag(k) over w <> 't', false) inlist, coalesce(last_value(case when k <> 'b' then k end ignore nulls) over (partition by doc order by unit rows between unbounded preceding and 1 preceding) = 'p', false) indef from k window w as (partition by doc order by unit)),
m as (select *, case when k = 'b' then {_trim("substr(text, 2)")} else text end body from s)
select doc, unit, (case when (k = 't') = inlist then chr(10) else '' end) || (case when k = 'p' then '- ' when k = 'b' then (case when indef then '  ' else '' end) || '- ' else '' end)
  || regexp_replace(body, '((?:[!-;=?-_a-~]|<[^\\s<>](?:[^<>\\n]{{0,38}}[^\\s<>])?>)*<[^\\s<>](?:[^<>\\n]{{0,38}}[^\\s<>])?>(?:[!-;=?-_a-~]|<[^\\s<>](?:[^<>\\n]{{0,38}}[^\\s<>])?>)*)', '`\\1`', 'g') || chr(10) as out from m"""
)

BLANKS = Relation("doc string, line_no int, line string", [("a", i + 1, x) for i, x in enumerate(["", "x", "", "y", "", "　", "z", " ", "\t", "", "w", ""])] + [("b", i + 1, x) for i, x in enumerate(["", "", "q"])], ("lines", ["concat('d', doc_id)", "cast(line_no as int)", "line"], f"select 'd' || doc_id, line_no::int, line from ({DOCUMENT_LINES})"))


def table_blank_collapse(spark, sf):
    return L.fold_blanks(BLANKS.df(spark, sf), ["doc"])


INDENTED = Relation("doc string, line_no int, line string", [("a", 1, "    ip route"), ("a", 2, "      more"), ("a", 3, "　"), ("a", 4, "    "), ("a", 5, "     x"), ("b", 1, "none"), ("b", 2, "  two"), ("c", 1, " "), ("c", 2, "")], ("lines", ["concat('d', doc_id)", "cast(line_no as int)", "line"], f"select 'd' || doc_id, line_no::int, line from ({DOCUMENT_LINES})"))


def dedent_lines(spark, sf):
    t = INDENTED.df(spark, sf).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).getField("line").alias("lines"))
    return t.select("doc", F.posexplode(T.dedent(F.col("lines"))).alias("i", "line"))


def heading_line_numbers(spark, sf):
    """Turns of a conversation as items of a file: the line at which each begins."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return L.item_lines(t, ["conv_id"], "turn").select("conv_id", "turn", F.col("line").cast("long").alias("line"))


def section_first_seen(spark, sf):
    return L.first_seen(table(spark, sf, "documents"), ["lang", "source"], "doc_id")


def chapter_last_wins(spark, sf):
    return L.last_wins(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


def header_fill_down(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type")).alias("header"))
    return L.filled_down(e, ["user_id"], "event_id", "header")


TITLES = Relation(
    "title string, version string",
    [(t, v) for t in ("Guide 1.5a版", "Guide 1.5ab", "Guide 11.5a", "Guide 1.5a.1", "v1.5a-beta 1.5a+build", "(1.5a) and 2.0", "") for v in ("1.5a", "2.0", "beta")], ("part", ["concat(p_name, ' (', p_size, '.', p_partkey % 7, ') ', p_brand)", "concat(p_size, '.', p_partkey % 5)"], "select p_name || ' (' || p_size || '.' || p_partkey % 7 || ') ' || p_brand, p_size || '.' || p_partkey % 5 from part"))


def version_token_match(spark, sf):
    return TITLES.df(spark, sf).select("title", "version", T.matches_version(F.col("title"), F.col("version")).alias("ok"))


def font_mode(spark, sf):
    """Mode of a synthetic size of each document's characters, by source: counts first, so that no document is expanded."""
    d = table(spark, sf, "documents").where("text is not null")
    sized = d.select("source", (F.length("text") % 7 * 12 + 900).alias("s"))
    return L.mode(sized, ["source"], F.col("s").cast("long"), "size")


def upper_median_gap(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("before", F.lag("ts").over(w)).withColumn("gap", F.expr("timestampdiff(MICROSECOND, before, ts)"))
    return L.upper_median(e, ["user_id"], "gap")


NAMES = Relation("s string", [("A/B",), ("A:B",), (" . ",), ("IPv4 パケットフィルタ",), ("x" * 70,), ("a|b?c*",), ("..dots..",), ("",)], ("lines", ["line"], f"select line from ({DOCUMENT_LINES})"))


def name_functions(spark, sf):
    s = F.col("s")
    return NAMES.df(spark, sf).select("s", T.safe_name(s).alias("name"), T.link_target(s).alias("link"), T.tsv_cell(F.concat(s, F.lit("\tq\nr "))).alias("cell"), T.chapter_folder(F.length(s), s).alias("folder"), T.table_cell(F.concat(s, F.lit("&<b>\\|\n"))).alias("gfm"))


_SAFE = f"""case when regexp_replace(regexp_replace({_trim('s')}, '[<>:"/\\\\|?*\\x{{00}}-\\x{{1F}}]', '-', 'g'), '^[ .]+|[ .]+\\z', '', 'g') = '' then '無題'
 else substr(regexp_replace(regexp_replace({_trim('s')}, '[<>:"/\\\\|?*\\x{{00}}-\\x{{1F}}]', '-', 'g'), '^[ .]+|[ .]+\\z', '', 'g'), 1, 60) end"""

FOOTERS = Relation("s string", [("2-13 ルータの設定",), ("ルータの設定　 10-2",), ("no number",), ("a 1-2 b 3-4",), ("",)], ("customer", ["concat(c_name, ' ', c_custkey, '-', c_nationkey)"], "select c_name || ' ' || c_custkey || '-' || c_nationkey from customer"))


def page_functions(spark, sf):
    s = F.col("s")
    f, h = T.footer_section(s), T.running_header(s, " ")
    return FOOTERS.df(spark, sf).select("s", f["section"].alias("section"), f["printed"].alias("printed"), T.chapter_of(f["printed"]).alias("chapter"), T.first_token(s).alias("token"), h["chapter"].alias("head"), h["section"].alias("tail"), T.heading_number(F.concat(s, F.lit("２．１０"))).alias("ascii"), T.text_key(s).alias("key"))


REFS = Relation("path string, anchor string, page int", [("", "", 0), ("", "", 1057), ("cli/a.html", "enable", 0), ("cli/a.html", "", 7)], ("pages", ["url", "if(page_id % 2 = 0, 'a', '')", "cast(page_id % 50 as int)"], "select url, case when page_id % 2 = 0 then 'a' else '' end, (page_id % 50)::int from pages"))


def source_refs(spark, sf):
    return REFS.df(spark, sf).select("*", T.source_ref(F.col("path"), F.col("anchor"), F.col("page")).alias("ref"))


BOOKS = Relation("series string, book string", [(s, b) for s in ("one", "two", "") for b in ("crm", "fd", "ex", "slog", "", "guide")])


def manifest_checks(spark, sf):
    return BOOKS.df(spark).select("*", T.doc_error(F.col("series"), F.col("book")).alias("error"))


SPECS = Relation("spec string, pages int", [("3,1-2,2", 5), ("0-4", 3), ("2-1", 5), ("", 3), ("9", 3), ("1,x", 4), (" 2 - 3 , 1", 4), ("1,,2", 4)])


def page_spec(spark, sf):
    return SPECS.df(spark).select("spec", "pages", T.page_list(F.col("spec"), F.col("pages")).cast("array<int>").alias("list"))


GLYPHS = Relation("page int, seq int, lo double, hi double", [(p, i, 10.0 * i + p % 2, 10.0 * i + 8) for p in range(1, 31) for i in (1, 2, 3, 4, 7, 8, 9)] + [(31, 1, 52.0, 60.0)])


def empty_band(spark, sf):
    """The widest run of x positions that at most a tenth of the pages use, inside the middle half."""
    from quire.operators.calibrate import occupied, widest_empty

    return widest_empty(occupied(GLYPHS.df(spark)), 31, 0, 100)


def column_match(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    n = F.length(F.regexp_replace("text", T.SPACE, ""))
    half = F.floor(F.length("text") / 2).cast("int")
    t = d.select("doc_id", F.substring("text", F.lit(1), half).alias("l"), F.substring("text", half + 1, F.length("text")).alias("r"), (n + F.col("doc_id") % 9 * 6).alias("n"))
    return t.select("doc_id", T.columns_match(F.col("l"), F.col("r"), F.col("n")).alias("ok"))


NUMBERS = Relation("s string", [("3",), ("0",), (" 7 ",), ("x",), ("",), ("-2",), ("99999999999",)], ("orders", ["if(o_orderkey % 3 = 0, o_orderpriority, concat(' ', o_orderkey))"], "select case when o_orderkey % 3 = 0 then o_orderpriority else ' ' || o_orderkey end from orders"))


def defaults(spark, sf):
    s = F.col("s")
    return NUMBERS.df(spark, sf).select("s", T.or_default(s, "int", 1, 1).alias("span"), T.or_default(s, "double", 0.0).alias("coordinate"), T.columns_wide(F.concat(s, F.lit("漢字ab"))).cast("long").alias("columns"))


def spacing(spark, sf):
    t = spark.sql("select id * 0.25 gap from range(40)").crossJoin(spark.sql("select explode(array(0.0D, 4.0D)) spacing"))
    return t.select(F.col("gap").cast("double").alias("gap"), "spacing", T.blank_lines(F.col("gap").cast("double"), F.col("spacing")).alias("blank"))


PAGES = Relation(
    "book string, page int, line_no int, line string",
    [
        ("b", 1, 1, "目次"), ("b", 1, 2, "1. 概要 .... 3"), ("b", 2, 1, "■ip route"), ("b", 2, 2, "入力形式"), ("b", 2, 3, "  ip route DEST"), ("b", 2, 4, ""), ("b", 2, 5, "説明  経路を"), ("b", 2, 6, "設定する。"),
        ("b", 3, 1, "続きの行"), ("b", 3, 2, "ユーザ権限"), ("b", 3, 3, "管理者"), ("b", 3, 4, "■show ip"), ("b", 3, 5, "前書き"), ("b", 3, 6, "入力形式"), ("b", 3, 7, "show ip route"), ("b", 4, 1, "索引"),
    ],
)
FIELD_LABELS = ["入力形式", "パラメータ", "説明", "デフォルト値", "実行モード", "ユーザ権限", "入力例", "ノート"]


def page_entries(spark, sf):
    t = L.entries(PAGES.df(spark), "book", "■", FIELD_LABELS)
    return t.select("book", "entry", "title", "page", "field", "label", F.array_join("lines", "|").alias("lines"))


_LABEL = "case " + " ".join(f"when t = '{x}' or starts_with(t, '{x}  ') then '{x}'" for x in FIELD_LABELS) + " end"

PRINTED = Relation("book string, page int, printed string, full_lines array<string>", [("b", 1, "1-1", ["x", " 2. no", "1. はじめに "]), ("b", 2, "1-2", ["1. not a title page"]), ("b", 3, "2-1", ["2.設定"]), ("b", 9, "2-1", ["2. 設定編", "2. later line"]), ("b", 10, "", ["3. none"])])


def chapter_title_pages(spark, sf):
    return L.chapter_titles(PRINTED.df(spark), "book")


LINKS = Relation("folder string, target string", [("ch01-a", "ch01-a/x.md"), ("ch01-a", "ch02-b/y.md"), ("", "z/q.md"), ("a/b/c", "a/d.md"), ("a/b", "a/b"), ("x", "f.md"), ("/a//b/", "a/b/c/d.md")])


def relative_links(spark, sf):
    return LINKS.df(spark).select("folder", "target", T.relative_link(F.col("folder"), F.col("target")).alias("link"))


def field_rules(spark, sf):
    """Lines of all documents: those that say a field is empty, with a prefix before each line of their text, and kinds of difference titles."""
    d = table(spark, sf, "documents").where("text is not null")
    last = F.substring_index("text", "\n", -1)
    own = d.select("doc_id", F.array(F.when(F.col("doc_id") % 5 == 0, F.lit(" 特になし ")).when(F.col("doc_id") % 5 == 1, F.lit("-")).otherwise(last)).alias("l"), F.concat(F.element_at(F.array(*(F.lit(w) for w, _ in C.DIFFERENCE_KINDS), F.lit("x")), (F.col("doc_id") % (len(C.DIFFERENCE_KINDS) + 1) + 1).cast("int")), F.lit(" "), last).alias("title"), "text")
    return own.select("doc_id", T.is_empty_field(F.col("l")).alias("empty"), C.difference_kind(F.col("title")).alias("kind"), F.sha2(T.prefix_lines(F.col("text"), "> "), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (relative_links, field_rules, collapse_text, line_kind_counts, interior_gap_max, logical_lines, logical_lines_japanese, render_body_state, table_blank_collapse, dedent_lines, heading_line_numbers, section_first_seen, chapter_last_wins, header_fill_down, version_token_match, font_mode, upper_median_gap, name_functions, page_functions, source_refs, manifest_checks, page_spec, empty_band, column_match, defaults, spacing, page_entries, chapter_title_pages)
}

_KINDS = C.DIFFERENCE_KINDS
ORACLE_SQL = {
    "relative_links": f"""with t as (select *, list_filter(string_split(folder, '/'), lambda p: p <> '') a, list_filter(string_split(target, '/'), lambda p: p <> '') b from {LINKS.sql()}),
s as (select *, len(list_filter(range(1, len(a) + 1), lambda n: n < len(b) and a[1:n] = b[1:n])) same from t)
select folder, target, repeat('../', (len(a) - same)::int) || array_to_string(b[same + 1:], '/') link from s""",
    "field_rules": f"""with t as (select doc_id, text, string_split(text, chr(10))[-1] last from documents where text is not null),
u as (select *, case doc_id % 5 when 0 then ' 特になし ' when 1 then '-' else last end l, [{', '.join(f"'{w}'" for w, _ in _KINDS)}, 'x'][(doc_id % {len(_KINDS) + 1} + 1)::int] || ' ' || last title from t)
select doc_id, {_trim('l')} in ({', '.join(f"'{x}'" for x in T.EMPTY_FIELDS)}) empty, case {' '.join(f"when contains(title, '{w}') then '{k}'" for w, k in _KINDS)} end kind,
sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when i = len(string_split(text, chr(10))) and x = '' then '' else '> ' || x end), chr(10))) digest from u""",
    "collapse_text": f"select doc_id, sha256({_collapse('text')}) digest, length({_collapse('text')})::bigint n from documents where text is not null",
    "line_kind_counts": f"""with l as (select line from ({_lines}) union all select line from {LINES.sql()}), r as (select {_RULE} rule from l)
select rule, case when rule in ('gap', 'foreign', 'short') then 'layout' when rule = 'blank' then 'blank' else 'prose' end kind, count(*) n from r group by all""",
    "interior_gap_max": f"select doc_id, max({_GAP})::bigint gap from ({_lines}) group by all",
    "logical_lines": _units(_lines, "doc_id") + " select doc_id, count(*) units, sha256(string_agg(text, chr(10) order by unit)) digest from r group by all",
    "logical_lines_japanese": _units(f"select * from {WRAPPED.sql()}", "doc") + " select doc, unit, text from r",
    "render_body_state": _RENDER,
    "table_blank_collapse": f"""with t as (select *, {_trim('line')} = '' b from {BLANKS.sql()}), g as (select *, sum((not b)::int) over (partition by doc order by line_no) g from t),
n as (select *, row_number() over (partition by doc, g, b order by line_no) k from g) select doc, line_no, line from n where not b or k = 2""",
    "dedent_lines": f"""with t as (select *, length(line) - length(ltrim(line, ' ')) n, {_trim('line')} <> '' r from {INDENTED.sql()}),
m as (select *, coalesce(min(case when r then n end) over (partition by doc), 0) m from t) select doc, (line_no - 1)::int i, case when n >= m then substr(line, m + 1) else ltrim(line, ' ') end line from m""",
    "heading_line_numbers": "select conv_id, turn, (3 + coalesce(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0))::bigint line from conversations",
    "section_first_seen": "select lang, source, min(doc_id) first_seen, count(*) n from documents group by all",
    "chapter_last_wins": "select user_id, arg_max(event_type, {'a': ts, 'b': event_id}) event_type from events group by all",
    "header_fill_down": "select user_id, event_id, coalesce(last_value(case when event_type <> 'error' then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), '') header from events",
    "version_token_match": f"select title, version, list_contains(regexp_extract_all(title, '{T.VERSION}'), version) ok from {TITLES.sql()}",
    "font_mode": "with c as (select source, (length(text) % 7 * 12 + 900)::bigint size, count(*) n from documents where text is not null group by all), r as (select *, row_number() over (partition by source order by n desc, size desc) k from c) select source, size, n from r where k = 1",
    "upper_median_gap": """with g as (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) gap from events),
r as (select user_id, gap, row_number() over (partition by user_id order by gap) k, count(*) over (partition by user_id) n from g where gap is not null) select user_id, gap median from r where k = n // 2 + 1""",
    "name_functions": f"""select s, {_SAFE} as name, case when regexp_matches(s, '[ ()]') then '<' || s || '>' else s end link,
{_collapse("replace(replace(s || chr(9) || 'q' || chr(10) || 'r ', chr(9), ' '), chr(10), ' / ')")} cell,
case when length(s) > 0 then 'ch' || (case when length(s) < 10 then lpad(length(s)::varchar, 2, '0') else length(s)::varchar end) || '-' || ({_SAFE}) else 'ch00-その他' end folder,
replace(replace(replace(replace(replace(replace(s || '&<b>\\|' || chr(10), '\\', '\\\\'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), chr(10), '<br>') gfm from {NAMES.sql()}""",
    "page_functions": f"""with t as (select s, regexp_extract(s, '\\b(\\d+-\\d+)\\b', 1) p from {FOOTERS.sql()})
select s, case when p = '' then '' else {_collapse("substr(s, 1, instr(s, p) - 1) || substr(s, instr(s, p) + length(p))")} end section, p printed, coalesce(try_cast(split_part(p, '-', 1) as int), 0) chapter,
regexp_extract(s, '^{WS}*([^\\t-\\r \\x{{85}}\\x{{A0}}\\x{{3000}}]+)', 1) token, case when instr(s, ' ') > 0 then substr(s, 1, instr(s, ' ') - 1) else '' end head, case when instr(s, ' ') > 0 then substr(s, instr(s, ' ') + 1) else s end tail,
translate(s || '２．１０', '０１２３４５６７８９．', '0123456789.') ascii, regexp_replace(s, '{WS}', '', 'g') key from t""",
    "source_refs": f"select *, case when path <> '' and anchor <> '' then path || '#' || anchor when path <> '' then path when page > 0 then 'p' || page else '' end ref from {REFS.sql()}",
    "manifest_checks": f"select *, case when book = '' then 'no book' when book not in ('crm', 'fd', 'ex', 'slog') then 'unknown book' when series = '' then 'no series' end error from {BOOKS.sql()}",
    "page_spec": f"""with t as (select row_number() over () id, * from {SPECS.sql()}), p as (select id, pages, unnest(string_split(spec, ',')) x, generate_subscripts(string_split(spec, ','), 1) i from t),
q as (select *, try_cast(trim(split_part(x, '-', 1)) as int) a, try_cast(trim(case when contains(x, '-') then split_part(x, '-', 2) else x end) as int) b from p),
g as (select id, bool_and(a is not null and b is not null and a <= b) ok from q group by id),
e as (select id, i, unnest(generate_series(greatest(a, 1), least(b, pages))) v from q where a is not null and b is not null and a <= b),
f as (select id, v, min(i * 100000 + v) o from e group by all), l as (select id, list(v order by o) v from f group by id)
select spec, pages, case when trim(spec) = '' then generate_series(1, pages)::int[] when ok then v::int[] end list from t join g using (id) left join l using (id)""",
    "empty_band": f"""with u as (select distinct page, unnest(generate_series(floor(lo)::int, ceil(hi)::int)) x from {GLYPHS.sql()}), c as (select x, count(*) n from u group by x),
a as (select unnest(generate_series(25, 75)) x), e as (select a.x from a left join c using (x) where coalesce(n, 0) <= 3), g as (select x, x - row_number() over (order by x) g from e),
r as (select min(x) start, max(x) stop, count(*) size from g group by g) select start, stop, size from r where size >= 2 order by size desc, start limit 1""",
    "column_match": f"""with t as (select doc_id, substr(text, 1, length(text) // 2) l, substr(text, length(text) // 2 + 1) r, length(regexp_replace(text, '{WS}', '', 'g')) + doc_id % 9 * 6 n from documents where text is not null),
c as (select *, length(regexp_replace(l, '{WS}', '', 'g')) a, length(regexp_replace(r, '{WS}', '', 'g')) b from t) select doc_id, abs(a + b - n) <= least(24, greatest(4, n // 50)) and b > 0 ok from c""",
    "defaults": f"select s, coalesce(case when try_cast(trim(s) as int) >= 1 then try_cast(trim(s) as int) end, 1) span, coalesce(try_cast(trim(s) as double), 0) coordinate, (length(s) + 6)::bigint as columns from {NUMBERS.sql()}",
    "spacing": "select g * 0.25::double gap, s::double spacing, case when s > 0 and g * 0.25 / s >= 2.2 then 2 when s > 0 and g * 0.25 / s >= 1.35 then 1 else 0 end blank from range(40) t(g), (values (0), (4)) v(s)",
    "page_entries": f"""with l as (select *, {_trim('line')} t from {PAGES.sql()}), m as (select *, starts_with(t, '■') mark, {_LABEL} label from l),
n as (select *, bool_or(mark or t in ({', '.join(f"'{x}'" for x in FIELD_LABELS)})) over (partition by book, page) u from m), e as (select *, sum(mark::int) over (partition by book order by page, line_no) entry from n where u),
f as (select *, sum((label is not null and not mark)::int) over (partition by book, entry order by page, line_no) field from e where entry > 0),
x as (select *, case when mark then null when label is not null then nullif({_trim("substr(t, length(label) + 1)")}, '') when t = '' then '' else line end body from f),
h as (select book, entry, {_trim("substr(t, 2)")} title, page from x where mark),
b as (select book, entry, field, replace(max(label), 'ユーザ権限', 'ユーザー権限') label, coalesce(string_agg(body, '|' order by page, line_no), '') lines from x where field > 0 group by all)
select book, entry::bigint entry, title, page, field::bigint field, label, lines from h left join b using (book, entry)""",
    "chapter_title_pages": f"""with p as (select book, page, split_part(printed, '-', 1)::int chapter, unnest(full_lines) l, generate_subscripts(full_lines, 1) i from {PRINTED.sql()} where printed like '%-1'),
m as (select *, try_cast(regexp_extract({_trim('l')}, '^(\\d+)\\.', 1) as int) n, regexp_extract({_trim('l')}, '^\\d+\\.\\s*(\\S.*?)\\s*\\z', 1) title from p),
o as (select book, page, chapter, arg_min(title, i) title from m where n = chapter and title <> '' group by all) select book, chapter, arg_max(title, page) title from o group by all""",
}
