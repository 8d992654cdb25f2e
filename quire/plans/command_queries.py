"""Queries on commands, indexes, devices and fetching, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import commands as C
from quire.functions import text as T
from quire.operators import device as D
from quire.operators import fetching as H
from quire.operators import index as I
from quire.plans.relations import Relation, table
from quire.plans.text_queries import WS, _trim

_KW = "list_filter(string_split(regexp_replace({c}, '[\\t-\\r \\x{{3000}}\\x{{A0}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _keywords(c: str) -> str:
    t = _KW.format(c=c)
    return f"list_slice({t}, 1, coalesce(nullif(list_position(list_transform({t}, lambda x: regexp_matches(x, '^[a-z][a-z0-9./-]*\\z')), false), 0) - 1, len({t})))"


def _family(c: str) -> str:
    k = _keywords(c)
    return f"array_to_string(list_slice({k}, 1, case when {k}[1] in ('show', 'clear') then 3 else 2 end), ' ')"


SYNTAX = Relation(
    "entry int, field int, line_no int, line string",
    [
        (1, 1, 1, "  crypto map NAME [aes-128][aes-192"), (1, 1, 2, "      ][aes-256]"), (1, 1, 3, "  no crypto map NAME"), (2, 1, 1, "    snmp ip trap"), (2, 1, 2, "  no snmp ip trap"), (2, 1, 3, "snmp ipv6 trap"), (2, 2, 1, "snmp ip trap"), (2, 2, 2, " HOST"),
        (3, 1, 1, "ADDRESS] lost"), (3, 1, 2, ""), (3, 1, 3, "ip a"), (3, 1, 4, "[ B ]"), (3, 1, 5, "ip a [ B ]"), (4, 1, 1, "no x"),
    ],
)


def commands_of(spark, sf):
    t = SYNTAX.df(spark).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("field", "line_no", "line"))).alias("x"))
    return t.select("entry", F.posexplode(C.commands_of(F.col("x"))).alias("i", "command"))


def family_counts(spark, sf):
    p = table(spark, sf, "part").select(C.family(F.lower("p_name")).alias("family"), "p_partkey")
    return p.groupBy("family").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def _sides(spark, sf):
    """Two series that share the table between them: one brand, and all others."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.lower("p_name").alias("command"), F.concat(F.lit("p"), "p_partkey").alias("source"), (F.col("p_brand") == "Brand#11").alias("one"))
    return p.where("one is null or not one").drop("one"), p.where("one").drop("one")


def family_setdiff(spark, sf):
    left, right = _sides(spark, sf)
    return I.set_diff(left, right, spark.createDataFrame([("almond antique x",), ("none",)], "command string"))


INDEX = Relation("ord int, command string, source string", [(1, "ip route NETWORK", "p1"), (2, "reload", "p2"), (3, "pki cert erase { name NAME | all }", "p3"), (4, "ip missing-example on", "p3"), (5, "ip route NETWORK again", "p4"), (6, "show ip route detail", "p5"), (7, "[ x ]", "p6")])
TEXTS = Relation("id int, text string", list(enumerate(["ip", "ip route", "reload", "reload now", "pki cert erase name NAME", "show ip route", "show ip route detail VRF", "Nothing", "", "ip missing-example"])))


def command_lookup_top1(spark, sf):
    return I.lookup(TEXTS.df(spark), INDEX.df(spark)).select("id", "text", "command", "source", "n")


def part_lookup_top1(spark, sf):
    """Every part's name looked up in an index of all distinct names."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text"))
    index = p.groupBy(F.col("text").alias("command")).agg(F.min("id").alias("ord")).select("ord", "command", F.concat(F.lit("p"), "ord").alias("source"))
    return I.lookup(p, index).select("id", "source")


_LOOKUP = """with w as (select *, {kw} k from ({texts})), h as (select *, {kh} k from ({index})),
m as (select w.id, h.command, h.source, h.ord, least(len(w.k), len(h.k)) n from w, h
  where len(w.k) > 0 and len(h.k) > 0 and list_slice(w.k, 1, least(len(w.k), len(h.k))) = list_slice(h.k, 1, least(len(w.k), len(h.k))) and (len(w.k) = len(h.k) or least(len(w.k), len(h.k)) >= 2)),
r as (select *, row_number() over (partition by id order by n desc, ord) p from m)"""

ALTERNATIVES = Relation("id int, s string", [(1, "[ ip | ipv6 ] ufs-cache enable"), (2, "{ a | b } x [ c | d ]"), (3, "[ NAME | all ] y"), (4, "plain"), (5, "show [ip | ipv6 | all]")], ("part", ["cast(100 + p_partkey as int)", "concat('[ ', replace(lower(p_name), ' ', ' | '), ' ] { a | b } ', p_size)"], "select (100 + p_partkey)::int, '[ ' || replace(lower(p_name), ' ', ' | ') || ' ] { a | b } ' || p_size from part"))


def expand_alternatives(spark, sf):
    return ALTERNATIVES.df(spark, sf).select("id", F.posexplode(C.open_alternatives(F.col("s"))).alias("i", "command"))


CELLS = Relation(
    "table_id string, kind string, ref string, row_no int, function string, command string, l string, r string, note string",
    [("t1", "renamed", "c8.html#a", 0, "経路", "[ ip | ipv6 ] x", "", "ip y\nipv6 y", "別名"), ("t1", "renamed", "c8.html#a", 1, "", "reload", "", "restart", ""), ("t2", "removed", "", 0, "再起動", "reload now", "", "reloadコマンドに統一", ""), ("t3", "moved", "c8.html#b", 0, "鍵", "pki cert erase all", "global", "interface", "")],
)
HEADS = {"t1": ["機能", "IXシリーズ", "IX-Rシリーズ", "備考"], "t2": ["機能", "設定コマンド", "IXシリーズ", "IX-Rシリーズ"], "t3": ["機能", "設定コマンド", "IXシリーズ", "IX-Rシリーズ"]}
DERIVED = Relation("ord int, kind string, left string, right string, source string, ref_left string, ref_right string, note string", [(1, "limit", "ip missing-example on", "", "derived", "fd:x", "", "n")])


def _tables(spark):
    rows = {}
    for t, kind, ref, _, f, c, left, r, note in CELLS.rows:
        rows.setdefault((t, kind, ref), [HEADS[t]]).append([f, c, r, note] if kind == "renamed" else [f, c, left, r])
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "table_id string, kind string, ref string, rows array<array<string>>")


def difference_rows(spark, sf):
    """Table rows, derived rows and missing families, in one table."""
    right = spark.createDataFrame([(1, "ip route X", "w1"), (2, "restart", "w2")], "ord int, command string, source string")
    return I.difference_table(_tables(spark), DERIVED.df(spark), INDEX.df(spark), right).select("part", *I.DIFFERENCE_COLUMNS)


_OPENED = (
    "with recursive o as (select {keys}, s c, [0] place from ({src}) union all select {keys}, trim(regexp_replace(substr(c, 1, instr(c, regexp_extract(c, '{alt}', 0)) - 1) || a || substr(c, instr(c, regexp_extract(c, '{alt}', 0)) + length(regexp_extract(c, '{alt}', 0))), ' +', ' ', 'g')), list_append(place, i) "
    "from (select *, unnest(string_split(regexp_extract(c, '{alt}', 1), ' | ')) a, generate_subscripts(string_split(regexp_extract(c, '{alt}', 1), ' | '), 1) i from o where regexp_matches(c, '{alt}')))"
)


def _opened(keys: str, src: str) -> str:
    return _OPENED.replace("{keys}", keys).replace("{src}", src).replace("{alt}", C.ALTERNATIVES)


ENTRIES = Relation("entry int, title string, cmds array<string>, file string, line int, source string", [(1, "経路", ["ip route A", "ip host B"], "ch01-a/x.md", 3, "p61"), (2, "再起動", [], "ch01-a/x.md", 20, "p62"), (3, "別の経路", ["ip route A", "clear ip"], "ch02-b/y.md", 3, "cli/a.html#b")])
HEADINGS = Relation("ord int, number string, anchor string, title string, file string, line int, source string", [(1, "2.1", "a", "概要", "f.md", 3, "p1"), (2, "", "intro", "はじめに", "f.md", 9, "a.html#intro"), (3, "2.2", "", "設定", "g.md", 3, "p9")])


def command_index_rows(spark, sf):
    return I.command_rows(ENTRIES.df(spark))


def section_index_rows(spark, sf):
    return I.section_rows(HEADINGS.df(spark))


def index_lookup_slice(spark, sf):
    """Bodies of the documents' lines that hold a word: every line is in the index, with its whole text as title."""
    from quire.operators.lines import exploded

    body = exploded(table(spark, sf, "documents"), "doc_id").select(F.concat(F.lit("d"), "doc_id").alias("file"), "line_no", F.col("line").alias("body"))
    index = body.select("file", F.col("line_no").alias("line"), F.col("body").alias("title"))
    return I.slices(index, body, "the").select("file", "line", "line_no", F.sha2("body", 256).alias("digest"))


FUNCTIONS = Relation("title string, file string", [("IKE, IPsec,  PPP", "s1.md"), ("BGP", "s2.md"), ("IPsec", "s3.md")])


def name_mapping(spark, sf):
    return I.named(FUNCTIONS.df(spark), spark.createDataFrame([("IPsec",), ("BGP",)], "name string"))


OUTPUTS = Relation(
    "id int, op string, command string, output string",
    [(i, "show", c, o) for i, (c, o) in enumerate([
        ("ip route x", "% ip route x -- 不正な入力"), ("ip route x", "% Invalid input"), ("a", "ok\n % unable to open"), ("copy a", "% Saved configuration"), ("save", "%CONFIG process is occupied."), ("x.y", "% xzy -- nothing"), ("x.y", "% X.Y -- what"), ("show", "% can't do"), ("show", "% errors: 0"), ("show", "no percent error"), ("", "% -- x"), ("a(b", "  %  a(b --  z"), ("s", "% was not permitted")])], ("conversations", ["cast(100 + conv_id * 1000 + turn as int)", "'show'", "split_part(coalesce(text, ''), ' ', 1)", "concat('% ', coalesce(text, ''))"], "select (100 + conv_id * 1000 + turn)::int, 'show', split_part(coalesce(text, ''), ' ', 1), '% ' || coalesce(text, '') from conversations"))


def diagnostic_status(spark, sf):
    return OUTPUTS.df(spark, sf).select("id", C.output_status(F.col("command"), F.col("output")).alias("status"))


_ERROR = r"""(trim(command) <> '' and regexp_matches(output, '(?im)^[ \t]*%[ \t]*' || regexp_replace(trim(command), '([\\.\[\]{}()*+?^$|\-])', '\\\1', 'g') || '[ \t]+--[ \t]*\S')) or regexp_matches(output, '(?im)^[ \t]*%[^\r\n]*\b(?:WORDS)\b')""".replace("WORDS", "|".join(C.FAILURE_WORDS).replace("'", "''"))
_STATUS = rf"case when regexp_matches(output, '(?im)^[ \t]*%[ \t]*CONFIG process is occupied\.') then 'occupied' when {_ERROR} then 'failed' else 'ok' end"

GATE = Relation("c string", [("show ip",), ("SHOW x",), ("showx",), (" show a",), ("show a\n",), ("show\ta",), ("config",), ("",), ("show",), ("show 漢字",), ("show　a",)])


def show_command_gate(spark, sf):
    """Every line of every document as a command, every second document's with `show` in front."""
    from quire.operators.lines import exploded

    lines = exploded(table(spark, sf, "documents"), "doc_id")
    own = lines.select(F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("show ")).otherwise(""), "line").alias("c"))
    return GATE.df(spark).unionByName(own).groupBy(C.is_show(F.col("c")).alias("ok")).agg(F.count("*").alias("n"))


FILES = Relation("id int, text string", [(1, "# c\n\n ip a  \r\n  no b\n\t\n#x\nlast"), (2, ""), (3, "one two\x0bthree")])


def config_lines(spark, sf):
    own = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    t = FILES.df(spark).select((F.col("id") * -1).cast("long").alias("id"), "text").unionByName(own).select("id", C.config_lines(F.col("text")).alias("l"))
    return t.select("id", F.size("l").cast("long").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("digest"))


def backup_names(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", C.backup_path(F.concat("event_type", F.lit(" /"), "user_id"), F.col("ts")).alias("path"))


TRANSCRIPT = Relation(
    "session string, seq int, op string, command string, output string",
    [("a", 1, "show", "show x", "fine"), ("a", 2, "backup", "show running-config", "text"), ("a", 3, "config", "ip q", "% ip q -- bad"), ("a", 4, "config", "ip r", ""), ("a", 5, "save", "write", ""), ("b", 1, "show", "show y", "% CONFIG process is occupied."), ("b", 2, "save", "write", "ok"), ("c", 1, "config", "x", "% saved"), ("c", 2, "save", "write", "%CONFIG process is occupied.")], ("conversations", ["concat('c', conv_id)", "cast(turn as int)", "if(role = 'user', 'config', 'show')", "split_part(coalesce(text, ''), ' ', 1)", "if(conv_id % 3 = 0, concat('% ', text, ' failed'), coalesce(text, ''))"], "select 'c' || conv_id, turn::int, case when role = 'user' then 'config' else 'show' end, split_part(coalesce(text, ''), ' ', 1), case when conv_id % 3 = 0 then '% ' || text || ' failed' else coalesce(text, '') end from conversations"))


def transcript_status(spark, sf):
    return D.executed(TRANSCRIPT.df(spark, sf)).select("session", "seq", "op", "status", F.when(F.col("status") == "failed", C.stopped_at(F.col("seq"), F.lit(5))).alias("message"))


DEVICES = Relation("name string, host string, hostname string, username string, user string, port string, password string, password_env string", [("r1", "192.0.2.1", "", "admin", "", "2222", "pw", ""), ("r2", "", "edge", "", "op", "", "", "R2_PASS"), ("r3", "", "", "", "", "x", "", ""), ("r4", "h4", "", "", "", "", "", "NONE")])
REQUESTS = Relation("id int, device string, host string, user string, port string", [(1, "r1", "", "", ""), (2, "r2", "", "root", ""), (3, "r3", "", "", ""), (4, "zz", "", "", ""), (5, "", "203.0.113.9", "", "99999"), (6, "", "", "", ""), (7, "r1", "198.51.100.7", "", "23")])
SSH = Relation("alias string, hostname string, user string, port string", [("edge", "192.0.2.20", "nobody", "2200"), ("198.51.100.7", "", "zed", "")])


def _inventory(spark):
    d = DEVICES.df(spark)
    names = [c for c in d.columns if c != "name"]
    return d.select("name", F.create_map(*(x for c in names for x in (F.lit(c), F.col(c)))).alias("entry"))


def target_resolution(spark, sf):
    return D.targets(REQUESTS.df(spark), _inventory(spark), SSH.df(spark))


def auth_sources(spark, sf):
    env = F.create_map(F.lit("R2_PASS"), F.lit("s"), F.lit("EMPTY"), F.lit(""), F.lit("FLAG"), F.lit("f"))
    flags = spark.createDataFrame([("",), ("FLAG",), ("EMPTY",)], "flag string")
    return _inventory(spark).crossJoin(F.broadcast(flags)).select("name", "flag", D.auth_source(F.col("flag"), env).alias("source"))  # three flags


def device_lines(spark, sf):
    t = _inventory(spark).select("name", D.entry_host().alias("host"), D.entry_user().alias("user"), D.auth_source(F.lit(""), F.create_map(F.lit("R2_PASS"), F.lit("s"))).alias("auth"), F.when(F.col("name") == "r3", F.lit("loop")).alias("route_error"))
    return D.device_list(t)


HOSTS = Relation("host string, proxyjump string", [("a", "b,c"), ("b", "d"), ("c", "b"), ("d", ""), ("x", "y"), ("y", "x"), ("n", "none"), ("p", "me@q:2200"), ("q", "d")])


def jump_routes(spark, sf):
    return D.jump_routes(spark, HOSTS.df(spark))


HOPS = Relation("spec string", [("me@host:22",), ("host",), ("a@b@h",), ("::1",), ("h:",), ("h:x",), ("u@",), ("h:70000",)], ("supplier", ["concat(if(s_suppkey % 3 = 0, '', 'me@'), 'h', s_suppkey, ':', s_suppkey * 131 % 70000)"], "select (case when s_suppkey % 3 = 0 then '' else 'me@' end) || 'h' || s_suppkey || ':' || s_suppkey * 131 % 70000 from supplier"))


def hop_parts(spark, sf):
    return HOPS.df(spark, sf).select("spec", D.split_hop(F.col("spec")).alias("h")).select("spec", "h.*")


DIRECTIVES = Relation(
    "patterns array<string>, ord int, key string, value string",
    [
        (["supplier#*1", "!supplier#*01"], 0, "User", "ones"), (["supplier#0000?????", "edge"], 1, "HostName", "192.0.2.7"), (["a"], 2, "HostName", "h1"), (["a"], 3, "HostName", "h2"), (["a"], 4, "ProxyJump", "j"), (["a"], 5, "ProxyCommand", "nc"), (["b"], 6, "ProxyCommand", "nc x"), (["b"], 7, "ProxyJump", "j"),
        (["c"], 8, "ProxyCommand", "none"), (["c"], 9, "User", "u"), (["d*", "e.?"], 10, "proxyjump", "none"), (["d*"], 11, "ProxyCommand", "nc y"), (["e.?"], 12, "User", "dot"), (["*", "!a"], 13, "Port", "2222"), (["*"], 14, "User", "all"), (["*"], 15, "Port", "22"),
    ],
)
ALIASES = Relation("alias string", [(x,) for x in ("a", "b", "c", "dd", "e.1", "exx", "edge", "(x", "")])


def ssh_effective(spark, sf):
    """Fixed aliases and one for every supplier."""
    return D.effective_ssh(DIRECTIVES.df(spark), ALIASES.df(spark).unionByName(table(spark, sf, "supplier").select(F.lower("s_name").alias("alias"))))


def mask_url_tokens(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("get "), "url", F.lit(" user "), F.regexp_replace("url", "://", "://u:p@"), F.lit(" a@b c?d")).alias("s"))
    return p.select("page_id", T.mask_url_tokens(F.col("s")).alias("masked"))


RETRIES = Relation("status int, header string, attempt int, least int", [(500, "", 0, 0), (500, "", 1, 0), (429, "0", 0, 1), (503, "8", 0, 0), (503, "31", 0, 0), (503, "invalid", 0, 0), (429, "-1", 0, 0), (503, "Thu, 26 Nov 2026 00:00:20 GMT", 0, 0), (503, "Thu, 26 Nov 2026 00:01:00 GMT", 0, 0), (404, "", 2, 0), (500, "9", 0, 0)])


def retry_plan(spark, sf):
    d = H.retry_delay(F.col("status"), F.col("header"), F.col("attempt"), F.col("least"), F.lit("2026-11-26 00:00:00").cast("timestamp"))
    return RETRIES.df(spark).select("*", H.retried(F.col("status"), F.col("attempt")).alias("again"), d["seconds"].alias("seconds"), d["error"].alias("error"))


def fetch_decisions(spark, sf):
    t = spark.sql("select s.* , b.*, t.*, f.* from values (200), (304), (404) s(status), values (true), (false) b(body), values (true), (false) t(tag), values (true), (false) f(force)")
    return t.select("*", H.fetch_action(F.col("status"), F.col("body"), F.col("tag"), F.col("force")).alias("action"))


CACHES = Relation("book string, version string, wanted string, paths array<string>", [("a", "1", "1", ["x.html", "i/y.png"]), ("b", "1", "2", []), ("c", "1", "1", ["../z"]), ("d", "1", "1", []), ("e", "1", "1", ["gone.html"])])
CACHED = Relation("book string, path string", [("a", "index.html"), ("a", "x.html"), ("a", "i/y.png"), ("b", "index.html"), ("c", "index.html"), ("c", "../z"), ("e", "index.html")])


def cache_completeness(spark, sf):
    return H.complete_caches(CACHES.df(spark), CACHED.df(spark))


MARKS = Relation("book string, sha256 string, own_sha256 string, dpi int, own_dpi int, pages int", [("a", "s", "s", 150, 150, 2), ("b", "s", "t", 150, 150, 1), ("c", "s", "s", 150, 150, 2), ("d", "s", "s", 150, 144, 1)])
IMAGES = Relation("book string, name string, size int", [("a", "p1.png", 5), ("a", "p2.png", 5), ("b", "p1.png", 5), ("c", "p1.png", 5), ("c", "p2.png", 0), ("d", "p1.png", 1)])


def figure_marks(spark, sf):
    return H.figures_done(MARKS.df(spark), IMAGES.df(spark))


FIGURES = Relation("ord int, name string", [(1, "p-001.png"), (2, "P1.JPG"), (3, "p0.png"), (4, "p12.jpeg"), (5, "q1.png"), (6, "p3.gif")])


def figure_names(spark, sf):
    return H.figure_pages(FIGURES.df(spark))


SCANS = Relation("ord int, name string, pages int, status string", [(1, "scan10.png", 2, "ok"), (2, "scan9.png", 1, "ok"), (3, "scan123456789012345678901234567890.png", 2, "ok"), (4, "a1b2.png", 0, "skipped"), (5, "cover.png", 0, "skipped"), (6, "scan009.png", 0, "error"), (7, "scan11.png", 2, "ok")])


def scan_numbering(spark, sf):
    s = SCANS.df(spark)
    n = H.numbered_files(s.select("ord", "name")).join(s.select("name", "pages"), "name")
    return H.page_numbers(n)


def scan_counts(spark, sf):
    return H.scan_report(SCANS.df(spark))


MANIFEST = Relation("name string, series string, book string, kind string, url string, version string, profile string, title string", [("", "ix", "crm", "", "http://h.example/dl?file=crm_v10.11.pdf&x=1", "", "", ""), ("n", "ix-r", "fd", "", "http://h.example/w/", "1.5a", "p.json", "T"), ("", "ix-r", "slog", "pdf", "http://h.example/d?file=s%2D1.2a", "", "", "")])


def manifest_defaults(spark, sf):
    return H.completed_docs(MANIFEST.df(spark))


def page_titles(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", H.page_title(F.col("html")).alias("title"), F.size(H.image_sources(F.col("html"))).cast("long").alias("images"))


SNIPPETS = Relation("id int, html string, url string, js string", [(1, '<p><img alt="x" src="a/b.png"><IMG src=\'c.svg\'><img src="http://e.example/d.png"><img src="a/b.png">', "http://h.example/a?x=1", 'Search.setIndex({docnames:["a","b/c"],x:1})'), (2, "none", "", "{}"), (3, "<img>", "http://h.example/a/", '{"docnames": []}')])


def web_snippets(spark, sf):
    return SNIPPETS.df(spark).select("id", F.array_join(H.image_sources(F.col("html")), "|").alias("images"), H.web_base(F.col("url")).alias("base"), F.array_join(H.search_documents(F.col("js")), "|").alias("docs"))


QUERIES = {
    f.__name__: f
    for f in (commands_of, family_counts, family_setdiff, command_lookup_top1, part_lookup_top1, expand_alternatives, difference_rows, command_index_rows, section_index_rows, index_lookup_slice, name_mapping, diagnostic_status, show_command_gate, config_lines, backup_names, transcript_status, target_resolution, auth_sources, device_lines, jump_routes, hop_parts, ssh_effective, mask_url_tokens, retry_plan, fetch_decisions, cache_completeness, figure_marks, figure_names, scan_numbering, scan_counts, manifest_defaults, page_titles, web_snippets)
}

_ERR_CONFIG = f"case when op = 'config' then (case when {_ERROR} then 'failed' else 'ok' end) else {_STATUS} end"
_HOPNAME = "regexp_replace(regexp_replace(hop, '^.*@', ''), ':[0-9]+$', '')"
_EH = "coalesce(nullif(d.host, ''), nullif(d.hostname, ''))"

ORACLE_SQL = {
    "commands_of": f"""with recursive l as (select *, {_trim('line')} t, length(line) - length(ltrim(line, ' ')) ind from {SYNTAX.sql()}),
r as (select * from l where t <> ''), b as (select *, first_value(ind) over (partition by entry, field order by line_no) base from r),
f as (select *, not (ind > base or not regexp_matches(t, '^[a-z]')) opens from b), u as (select *, sum(opens::int) over (partition by entry order by field, line_no) u from f),
c as (select entry, u, string_agg(t, ' ' order by field, line_no) command from u where u > 0 group by all), k as (select entry, command, min(u) u from c where not starts_with(command, 'no ') group by all)
select entry, (row_number() over (partition by entry order by u) - 1)::int i, command from k""",
    "family_counts": f"select {_family('lower(p_name)')} family, count(*) n, min(p_partkey) first_part from part group by 1",
    "family_setdiff": f"""with l as (select p_partkey ord, lower(p_name) command, 'p' || p_partkey source from part where p_brand is distinct from 'Brand#11'), f as (select *, {_family('command')} family from l),
there as (select distinct array_to_string(list_slice(k, 1, n), ' ') family from (select k, unnest(generate_series(1, len(k))) n from (select {_keywords('lower(p_name)')} k from part where p_brand = 'Brand#11')))
select family, count(*) n, arg_min(command, ord) example, arg_min(source, ord) source from f where family <> '' and family not in (select family from there) and family not in ('almond antique', 'none') group by family""",
    "command_lookup_top1": _LOOKUP.format(kw=_keywords("text"), kh=_keywords("command"), texts=f"select * from {TEXTS.sql()}", index=f"select * from {INDEX.sql()}") + " select w.id, w.text, r.command, r.source, r.n::int n from w left join r on w.id = r.id and r.p = 1",
    "part_lookup_top1": f"""with p as (select p_partkey, lower(p_name) name, {_keywords('lower(p_name)')} k from part), w as (select p_partkey id, k from p), h as (select min(p_partkey) ord, any_value(k) k from p group by name),
o as (select id, n, list_slice(k, 1, n) p from (select *, unnest(generate_series(1, len(k))) n from w) where n >= 2 or n = len(k)), u as (select ord, n, list_slice(k, 1, n) p from (select *, unnest(generate_series(2, len(k) - 1)) n from h)),
m as (select o.id, o.n, h.ord from o join h on h.k = o.p union all select w.id, u.n, u.ord from w join u on w.k = u.p),
r as (select *, row_number() over (partition by id order by n desc, ord) p from m) select w.id, case when r.ord is not null then 'p' || r.ord end source from w left join r on r.id = w.id and r.p = 1""",
    "expand_alternatives": _opened("id", f"select * from {ALTERNATIVES.sql()}") + f" select id, (row_number() over (partition by id order by place) - 1)::int i, c command from o where not regexp_matches(c, '{C.ALTERNATIVES}')",
    "difference_rows": _opened("table_id, kind, ref, row_no, function, l, r, note", f"select *, command s from {CELLS.sql()}")
    + f""", e as (select *, (row_number() over (partition by table_id, row_no order by place) - 1)::int i, string_split(r, chr(10)) rs from o where not regexp_matches(c, '{C.ALTERNATIVES}')),
x as (select *, {_keywords('c')} k from e), h as (select *, {_keywords('command')} hk from {INDEX.sql('q')}),
m as (select table_id, row_no, i, source, row_number() over (partition by table_id, row_no, i order by least(len(k), len(hk)) desc, ord) p from x, h where len(k) > 0 and len(hk) > 0 and list_slice(k, 1, least(len(k), len(hk))) = list_slice(hk, 1, least(len(k), len(hk))) and (len(k) = len(hk) or least(len(k), len(hk)) >= 2)),
own as (select 1 part, x.kind, c as left_, case x.kind when 'removed' then trim(regexp_extract(r, '{C.UNIFIED}', 1)) when 'renamed' then coalesce(rs[x.i + 1], rs[-1], '') else c end right_, 'ch8' source, coalesce('crm:' || m.source, '') ref_left, case when ref <> '' then 'fd:' || ref else '' end ref_right,
 array_to_string(list_filter(case x.kind when 'removed' then [function, 'IX-R: ' || r] when 'renamed' then [function, note] else [function, 'モード: ' || l || ' → ' || r] end, lambda z: z <> ''), '。') note from x left join m on m.table_id = x.table_id and m.row_no = x.row_no and m.i = x.i and m.p = 1),
der as (select 2 part, kind, "left" left_, "right" right_, source, ref_left, ref_right, note from {DERIVED.sql('dd')}),
there as (select * from (values ('ip'), ('ip route'), ('restart')) v(family)), told as (select {_family('left_')} family from (select left_ from own union all select left_ from der)),
fam as (select ord, command, source, {_family('command')} family from {INDEX.sql('qq')}),
ab as (select 3 part, 'absent' kind, family || ' *' left_, '' right_, 'setdiff' source, 'crm:' || arg_min(source, ord) ref_left, '' ref_right, count(*) || ' commands of the left index are missing on the right, such as ' || arg_min(command, ord) note from fam where family <> '' and family not in (select family from there) and family not in (select family from told) group by family)
select part, kind, left_ as "left", right_ as "right", source, ref_left, ref_right, note from (select * from own union all select * from der union all select * from ab)""",
    "command_index_rows": f"select unnest(cmds) command, title entry, file, line, source from {ENTRIES.sql()}",
    "section_index_rows": f"select coalesce(nullif(number, ''), anchor) section, title, file, line, source from {HEADINGS.sql()}",
    "index_lookup_slice": """with b as (select 'd' || doc_id file, unnest(string_split(text, chr(10))) body, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents where text is not null),
i as (select file, line_no line, body title, lead(line_no) over (partition by file order by line_no) nxt from b)
select b.file, i.line::int line, b.line_no::int line_no, sha256(body) digest from i join b on b.file = i.file and b.line_no >= i.line and b.line_no < least(coalesce(nxt, 2147483647), line + 30) where contains(title, 'the')""",
    "name_mapping": f"select title, file, name from (select *, unnest(regexp_split_to_array(title, ',\\s*')) as name from {FUNCTIONS.sql()}) where name in ('IPsec', 'BGP')",
    "diagnostic_status": f"select id, {_STATUS} status from {OUTPUTS.sql()}",
    "show_command_gate": f"""with c as (select c from {GATE.sql()} union all select (case when doc_id % 2 = 0 then 'show ' else '' end) || unnest(string_split(text, chr(10))) from documents where text is not null)
select not regexp_matches(c, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]') and not regexp_matches(c, '[\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]') and lower(regexp_extract({_trim('c')}, '^([^ ]*)', 1)) = 'show' ok, count(*) n from c group by 1""",
    "config_lines": f"""with f as (select (id * -1)::bigint id, text from {FILES.sql()} union all select doc_id, text from documents where text is not null),
l as (select id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')) line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{{0B}}\\x{{0C}}\\x{{1C}}-\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) i from f),
k as (select id, i, regexp_replace(line, '[\\t-\\r \\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{A0}}\\x{{3000}}]+\\z', '') line from l where {_trim('line')} <> '' and not starts_with({_trim('line')}, '#')),
g as (select id, count(*) n, string_agg(line, '|' order by i) s from k group by id) select f.id, coalesce(n, 0)::bigint n, sha256(coalesce(s, '')) digest from f left join g using (id)""",
    "backup_names": "select event_id, 'backups/' || regexp_replace(event_type || ' /' || user_id, '[^A-Za-z0-9._-]', '_', 'g') || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.conf' path from events",
    "transcript_status": f"""with s as (select *, {_ERR_CONFIG} s from {TRANSCRIPT.sql()}), t as (select *, coalesce(bool_or(s <> 'ok') over (partition by session order by seq rows between unbounded preceding and 1 preceding), false) x from s)
select session, seq, op, case when x then 'skipped' else s end status, case when not x and s = 'failed' then 'configuration stopped at config line ' || seq || ' of 5' end message from t""",
    "target_resolution": f"""with j as (select r.id, r.device, nullif(r.host, '') fh, nullif(r."user", '') fu, nullif(r.port, '') fp, d.name, {_EH} eh, coalesce(nullif(d.username, ''), nullif(d."user", '')) eu, nullif(d.port, '') ep, coalesce(nullif(r.host, ''), {_EH}, nullif(r.device, '')) asked from {REQUESTS.sql('r')} left join {DEVICES.sql('d')} on d.name = r.device),
k as (select j.*, nullif(s.hostname, '') sh, nullif(s."user", '') su, coalesce(fp, ep, nullif(s.port, ''), '22') p from j left join {SSH.sql('s')} on s.alias = j.asked),
e as (select *, try_cast(p as int) port, case when device <> '' and name is null and fh is null then 'unknown device ' || device when asked is null then 'no device and no host' when try_cast(p as int) is null or try_cast(p as int) not between 1 and 65535 then 'bad port' end error from k)
select id, case when error is null then coalesce(nullif(device, ''), asked) end as alias, case when error is null then coalesce(sh, asked) end host, case when error is null then coalesce(fu, eu, su, '') end as user, case when error is null then port end port, error from e""",
    "auth_sources": f"""select name, flag, case when flag = 'FLAG' then 'variable FLAG' when flag = 'EMPTY' then 'error: empty variable EMPTY' when password <> '' then 'inventory' when password_env = 'R2_PASS' then 'variable R2_PASS' else 'none' end source from {DEVICES.sql()}, (values (''), ('FLAG'), ('EMPTY')) f(flag)""",
    "device_lines": f"""with t as (select name, {_EH} host, coalesce(nullif(username, ''), nullif(d."user", '')) u, case when password <> '' then 'inventory' when password_env = 'R2_PASS' then 'variable R2_PASS' else 'none' end auth from {DEVICES.sql('d')}),
w as (select *, max(length(name)) over () a, max(length(coalesce(host, '-'))) over () b, max(length(coalesce(u, '-'))) over () c, max(length(auth)) over () e from t)
select name, rtrim(rpad(name, a::int, ' ') || '  ' || rpad(coalesce(host, '-'), b::int, ' ') || '  ' || rpad(coalesce(u, '-'), c::int, ' ') || '  ' || rpad(auth, e::int, ' ') || '  ' || case when name = 'r3' then 'route error: loop' else '' end) line from w""",
    "jump_routes": f"""with recursive h as (select * from {HOSTS.sql()}), j as (select host, trim(unnest(string_split(proxyjump, ','))) hop, generate_subscripts(string_split(proxyjump, ','), 1) - 1 pos from h where proxyjump <> '' and lower(trim(proxyjump)) <> 'none'),
n as (select *, {_HOPNAME} nm from j), r as (select host, hop, nm, [host, nm] way, [pos] place from n where nm <> host union all select r.host, n.hop, n.nm, list_append(r.way, n.nm), list_append(r.place, n.pos) from r join n on n.host = r.nm where not list_contains(r.way, n.nm)),
f as (select host, nm, arg_min(hop, list_append(place, 2147483647)) hop, min(list_append(place, 2147483647)) place from r group by all) select host, (row_number() over (partition by host order by place))::int step, hop from f""",
    "hop_parts": f"""with t as (select spec, case when contains(spec, '@') then regexp_extract(spec, '^(.*)@', 1) else '' end u, regexp_replace(spec, '^.*@', '') r from {HOPS.sql()}),
p as (select *, length(r) - length(replace(r, ':', '')) = 1 one from t), q as (select spec, u, case when one then split_part(r, ':', 1) else r end host, case when one then split_part(r, ':', 2) else '' end p, one from p)
select spec, u as user, host, try_cast(p as int) port, case when host = '' then 'no host' when one and (try_cast(p as int) is null or try_cast(p as int) not between 1 and 65535) then 'bad port' end error from q""",
    "ssh_effective": f"""with h as (select alias from {ALIASES.sql()} union select lower(s_name) from supplier), d as (select *, row_number() over () id from {DIRECTIVES.sql()}),
m as (select h.alias, d.ord, lower(key) key, value from h, d where len(list_filter(patterns, lambda p: not starts_with(p, '!') and alias glob p)) > 0 and len(list_filter(patterns, lambda p: starts_with(p, '!') and alias glob p[2:])) = 0),
f as (select alias, key, min(ord) ord, arg_min(value, ord) v from m group by all),
g as (select alias, max(v) filter (key = 'hostname') hostname, max(v) filter (key = 'user') u, max(v) filter (key = 'port') port, max(v) filter (key = 'proxyjump') pj, max(ord) filter (key = 'proxyjump') pjo, max(v) filter (key = 'proxycommand') pc, max(ord) filter (key = 'proxycommand') pco from f group by alias),
c as (select *, pc is not null and (coalesce(lower(trim(pj)), 'none') = 'none' or pco < pjo) is_command from g)
select h.alias, coalesce(hostname, '') hostname, coalesce(u, '') as user, coalesce(port, '') port, case when is_command then '' else coalesce(pj, '') end proxyjump, case when is_command and lower(pc) <> 'none' then 'ProxyCommand is unsupported' end error from h left join c using (alias)""",
    "mask_url_tokens": "select page_id, 'get ' || (case when contains(url, '?') or contains(url, '@') then '[REDACTED]' else url end) || ' user [REDACTED] a@b c?d' masked from pages",
    "retry_plan": f"""with t as (select *, 2 << attempt u, case when status in (429, 503) then case when regexp_matches(header, '^\\d+$') then header::int when header like '%GMT' then greatest(0, epoch(strptime(header, '%a, %d %b %Y %H:%M:%S GMT') - timestamp '2026-11-26 00:00:00'))::int end end o from {RETRIES.sql()})
select status, header, attempt, least as "least", status in (429, 500, 502, 503, 504) and attempt < 2 again, case when coalesce(o, 0) <= 30 then greatest(coalesce(o, u), "least")::int end as "seconds", case when o > 30 then 'asked to wait too long' end error from t""",
    "fetch_decisions": "select *, case when status = 200 then 'store' when status = 304 and body and tag and not force then 'keep' when status = 304 then 'error: unexpected 304' else 'error: status ' || status end action from (values (200), (304), (404)) s(status), (values (true), (false)) b(body), (values (true), (false)) t(tag), (values (true), (false)) f(force)",
    "cache_completeness": f"""with c as (select * from {CACHES.sql()}), a as (select book, unnest(list_append(paths, 'index.html')) path from c), f as (select * from {CACHED.sql()}),
l as (select distinct book from a where not exists (select 1 from f where f.book = a.book and f.path = a.path) or regexp_matches(path, '^/|(^|/)\\.\\.(/|$)')) select book, version = wanted and book not in (select book from l) complete from c""",
    "figure_marks": f"""with m as (select * from {MARKS.sql()}), p as (select book, 'p' || unnest(generate_series(1, pages)) || '.png' as name from m),
l as (select distinct p.book from p left join (select * from {IMAGES.sql('i')} where size > 0) i on i.book = p.book and i.name = p.name where i.name is null) select book, sha256 = own_sha256 and dpi = own_dpi and book not in (select book from l) done from m""",
    "figure_names": f"select regexp_extract(lower(name), '^p-?0*(\\d+)\\.(?:png|jpg|jpeg)$', 1)::int page, arg_max(name, ord) as name from {FIGURES.sql()} where try_cast(regexp_extract(lower(name), '^p-?0*(\\d+)\\.(?:png|jpg|jpeg)$', 1) as int) > 0 group by 1",
    "scan_numbering": f"""with t as (select *, regexp_replace(name, '\\.[^.]*$', '') base from {SCANS.sql()}), d as (select *, regexp_extract(base, '(\\d+)', 1) d from t where len(regexp_extract_all(base, '\\d+')) = 1),
k as (select *, row_number() over (order by d::hugeint, ord) k, count(*) over () n from d), f as (select substr(base, 1, instr(base, d) - 1) prefix, substr(base, instr(base, d) + length(d)) suffix, greatest(length(d), length((n * 2)::varchar)) width from k where k = 1),
s as (select *, coalesce(sum(pages) over (order by k rows between unbounded preceding and 1 preceding), 0) b from k), e as (select *, unnest(generate_series(1, pages)) part from s where pages > 0)
select name, part::int part, (b + part)::int number, prefix || lpad((b + part)::int::varchar, width::int, '0') || suffix || '.png' output from e, f""",
    "scan_counts": f"select count(*) filter (status = 'ok' and pages = 2) split, count(*) filter (status = 'ok' and pages = 1) copied, count(*) filter (status = 'error') errors, count(*) filter (status = 'skipped') skipped, sum(pages) filter (status = 'ok')::bigint pages from {SCANS.sql()}",
    "manifest_defaults": f"""with k as (select * replace (coalesce(nullif(kind, ''), case when series = 'ix-r' then 'web' else 'pdf' end) as kind, coalesce(nullif(profile, ''), 'profiles/' || series || '-' || book || '.json') as profile) from {MANIFEST.sql()}),
v as (select * replace (coalesce(nullif(version, ''), case when kind = 'pdf' then regexp_extract(url_decode(regexp_extract(url, '[?&]file=([^&]*)', 1)), '(\\d+(?:\\.\\d+)+[a-z]?)', 1) end, '') as version, coalesce(nullif(title, ''), series || ' ' || book) as title) from k)
select * replace (coalesce(nullif(name, ''), series || '-' || book || case when version <> '' then '-' || version else '' end) as name) from v""",
    "page_titles": f"select page_id, {_trim("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\r\\n\\x{3000}]+', ' ', 'g')")} title, len(list_distinct(regexp_extract_all(html, '(?is)<img[^>]*src=\"([^\"]*)\"', 1))) images from pages",
    "web_snippets": f"""with t as (select *, regexp_extract(js, '\"?docnames\"?\\s*:\\s*(\\[[^\\]]*\\])', 1) dn from {SNIPPETS.sql()})
select id, case id when 1 then 'a/b.png|c.svg' else '' end images, case when url <> '' then regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/*$', '/') || substr(url, length(regexp_extract(url, '^([^?#]*)', 1)) + 1) end base,
case when dn <> '' then array_to_string(from_json(dn, '["VARCHAR"]'), '|') end docs from t""",
}
