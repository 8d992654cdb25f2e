"""Jobs: a book's pages to files and indexes, two series' indexes to a difference table, and a manifest's documents one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import commands as C
from quire.functions import text as T
from quire.operators import html as H
from quire.operators import index as I
from quire.operators import layout as P
from quire.operators import lines as L
from quire.operators import output as O
from quire.operators import ruled as R
from quire.operators import sections as S
from quire.operators.arrow import mapped
from quire.sources import readers, sinks


def _named(items: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (chapter, section, n) with their files, and the names."""
    groups = L.first_seen(items, ["chapter", "section"], "n").join(titles, "chapter", "left")
    names = O.file_names(groups.select(F.lit("book").alias("book"), "chapter", F.col("title").alias("chapter_title"), "section", "first_seen"))
    return O.numbered(items.select(F.lit("book").alias("book"), "chapter", "section", F.col("n").alias("ord"), "text", *[c for c in items.columns if c not in ("chapter", "section", "n", "text")]), names), names


def _ordered(t: DataFrame) -> DataFrame:
    """Adds n: the place of each row in its book, pages by number and then rows by their order in the page."""
    from pyspark.sql import Window

    at = t.select("path", "ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("place", "ord")).alias("n"))  # one book's places, without its text
    return t.join(at, ["path", "ord"])


def _blocks(items: DataFrame) -> list:
    """Counts of a conversion: layout blocks (with a page book's tables, which are laid out), tables and figures."""
    of = lambda *kinds: F.coalesce(F.sum(F.size(F.filter("blocks", lambda b: b["kind"].isin(*kinds)))), F.lit(0))
    return [of("layout").alias("layout"), of("table").alias("tables"), of("figure").alias("figures")]


def _write_commands(e: DataFrame, titles: DataFrame, out: str) -> dict:
    """Entries (n, chapter, section, title, fields, cmds, source) to files and commands.tsv. No entry at all is an error."""
    schema = "n int, chapter int, section string, title string, text string, cmds array<string>, source string"
    items = mapped(e.select("n", "chapter", "section", "title", "fields", "cmds", "source"), lambda r: [{k: r[k] for k in ("n", "chapter", "section", "title", "cmds", "source")} | {"text": O.entry_markdown(r["title"], r["fields"])}], schema)
    placed, _ = _named(items, titles)
    placed = placed.persist()
    try:
        count = placed.count()
        if not count:
            raise ValueError("no entries")
        files = sinks.write_files(O.file_contents(placed), out)
        rows = I.command_rows(placed.select(F.col("ord").alias("entry"), "title", "cmds", "file", "line", "source"))
        return {"items": count, "files": files, "rows": sinks.write_tsv(rows, f"{out}/commands.tsv", readers.COMMANDS_HEADER)}
    finally:
        placed.unpersist()


def _write_sections(h: DataFrame, titles: DataFrame, out: str) -> dict:
    """Headings (n, chapter, section, number, anchor, title, source, depth, blocks) to files and sections.tsv. No heading at all is an error."""
    schema = "n int, chapter int, section string, number string, anchor string, title string, text string, source string"
    cols = ("n", "chapter", "section", "number", "anchor", "title", "source")
    h = h.persist()
    items = mapped(h.select(*cols, "depth", "blocks"), lambda r: [{k: r[k] for k in cols} | {"text": O.heading_markdown(r["number"], r["title"], r["depth"], r["blocks"])}], schema)
    placed, _ = _named(items, titles)
    placed = placed.persist()
    try:
        count = placed.count()
        if not count:
            raise ValueError("no headings")
        files = sinks.write_files(O.file_contents(placed), out)
        rows = I.section_rows(placed.select("ord", "number", "anchor", "title", "file", "line", "source"))
        return {"items": count, "files": files, "rows": sinks.write_tsv(rows, f"{out}/sections.tsv", readers.SECTIONS_HEADER)} | h.agg(*_blocks(h)).first().asDict()
    finally:
        placed.unpersist()
        h.unpersist()


def convert_commands(pages: DataFrame, labels: list[str], out: str) -> dict:
    """A command book in HTML (read_pages())."""
    return _write_commands(_ordered(H.entries(pages, labels)), H.chapter_titles(pages), out)


def convert_sections(pages: DataFrame, out: str) -> dict:
    """A book of headings in HTML."""
    return _write_sections(_ordered(H.headings(pages)), H.chapter_titles(pages), out)


def _page_marks(glyphs: DataFrame, profile: dict) -> DataFrame:
    """Rows (doc, page, printed, chapter, section) from what stands above and below the body: the printed page number `n-n`, and the section beside it or in the running head."""
    band = lambda where, name: P.page_text(glyphs.where(where), grid=False).select("doc", "page", T.collapse(F.col("text")).alias(name))
    y = (F.col("top") + F.col("bottom")) / 2
    pages = glyphs.select("doc", "page").distinct()
    t = pages.join(band(y > F.col("height") - profile["marginTop"], "head"), ["doc", "page"], "left").join(band(y < profile["marginBottom"], "foot"), ["doc", "page"], "left").fillna("")
    foot, head = T.footer_section(F.col("foot")), T.running_header(F.col("head"), profile["chapterSep"])
    section = foot["section"] if profile["footerSection"] else head["section"]
    return t.select("doc", "page", foot["printed"].alias("printed"), T.chapter_of(foot["printed"]).alias("chapter"), section.alias("section"))


def _titles(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (doc, chapter, title): of pages printed `n-1`, the line with the chapter's number."""
    text = lines.where("line is not null").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x")).select("doc", "page", F.col("x.line").alias("full_lines"))
    return L.chapter_titles(text.join(marks.select("doc", "page", "printed"), ["doc", "page"]), "doc").select("chapter", "title")


def _in_book(t: DataFrame, *order: str) -> DataFrame:
    """Adds n, the row's place in its book; one book's places, without its text."""
    from pyspark.sql import Window

    at = t.select("doc", *order, F.row_number().over(Window.partitionBy("doc").orderBy(*order)).alias("n"))
    return t.join(at, ["doc", *order])


def convert_glyph_commands(glyphs: DataFrame, profile: dict, out: str) -> dict:
    """A command book from its pages' glyphs: two columns or one, entries with their fields, files and commands.tsv."""
    lines, marks = P.command_pages(glyphs, profile), _page_marks(glyphs, profile)
    e = L.entries(lines, "doc", profile["entryMarker"], profile["fieldLabels"])
    own = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("field", "label", F.coalesce("lines", F.array().cast("array<string>")).alias("lines")))))
    e = e.groupBy("doc", "entry", "title", "page").agg(own.alias("fields"))
    syntax = F.flatten(F.transform(F.filter("fields", lambda f: f["label"] == profile["fieldLabels"][0]), lambda f: F.transform(f["lines"], lambda x: F.struct(f["field"].cast("int").alias("field"), x.alias("line")))))
    e = _in_book(e.withColumn("cmds", C.commands_of(syntax)).join(marks.select("doc", "page", "chapter", "section"), ["doc", "page"], "left"), "page", "entry")
    e = e.select("n", F.coalesce("chapter", F.lit(0)).alias("chapter"), F.coalesce("section", F.lit("")).alias("section"), "title", F.transform("fields", lambda f: F.struct(f["label"].alias("label"), f["lines"].alias("lines"))).alias("fields"), "cmds", F.concat(F.lit("p"), "page").alias("source"))
    return _write_commands(e, _titles(lines, marks), out) | {"pages": glyphs.select("page").distinct().count()}


def convert_glyph_sections(glyphs: DataFrame, rules: DataFrame, profile: dict, out: str) -> dict:
    """A book of headings from its pages' glyphs and ruled lines: text and tables in reading order, headings by number and size, tables with headers carried over pages, files and sections.tsv."""
    body, marks = glyphs.where(P.kept(top=profile["marginTop"], bottom=profile["marginBottom"])), _page_marks(glyphs, profile)
    tables = S.placed_tables(body, R.page_tables(body, rules)).join(marks.select("doc", "page", "section"), ["doc", "page"]).persist()
    try:
        carried = R.carried(tables).select("doc", "page", "ord", F.col("rows").alias("whole"))
        whole = tables.join(carried, ["doc", "page", "ord"]).select("doc", "page", "ord", "left", "right", "top", "bottom", F.col("whole").alias("rows"))
        lines = S.page_lines(body, whole)
        large = P.heading_lines(body, P.body_size(glyphs, profile["marginTop"], profile["marginBottom"]), profile["headingMinSize"])
        keys = large.groupBy("doc", "page").agg(F.collect_set("key").alias("found"))
        some = keys.select("doc").distinct().withColumn("any", F.lit(True))
        t = lines.join(marks, ["doc", "page"], "left").join(keys, ["doc", "page"], "left").join(some, "doc", "left")
        t = t.withColumn("headings", F.when(F.col("any"), F.coalesce("found", F.array().cast("array<string>"))))
        h = S.headings(t.select("doc", "page", "line_no", "line", "rows", "chapter", "section", "headings"))
        h = _in_book(h, "page", "ord").select("n", "chapter", "section", "number", F.lit("").alias("anchor"), "title", F.concat(F.lit("p"), "page").alias("source"), "depth", "blocks")
        got = _write_sections(h, _titles(lines, marks), out)
        return got | {"layout": got["layout"] + got["tables"], "pages": glyphs.select("page").distinct().count()}
    finally:
        tables.unpersist()


def convert(spark: SparkSession, folder: str, profile: dict, out: str) -> dict:
    """A folder of pages by its profile: with field labels a command book, without a book of headings."""
    pages = H.read_pages(readers.pages(spark, folder), profile["webUnnumberedHeadings"])
    return convert_commands(pages, profile["fieldLabels"], out) if profile["fieldLabels"] else convert_sections(pages, out)


def convert_glyphs(spark: SparkSession, glyphs: str, rules: str | None, profile: dict, out: str) -> dict:
    """A book's glyphs, and its ruled lines where it has a table of them, by its profile, as convert() does it for HTML."""
    g = readers.glyphs(spark, glyphs)
    if profile["fieldLabels"]:
        return convert_glyph_commands(g, profile, out)
    r = spark.read.parquet(rules) if rules else spark.createDataFrame([], "doc string, page int, vertical boolean, pos double, lo double, hi double")
    return convert_glyph_sections(g, r, profile, out)


def difference(spark: SparkSession, left_index: str, right_index: str, sections: str, folder: str, out: str, derived: str | None = None) -> int:
    """diff.tsv of two series from their indexes, the difference chapter and, where there is one, the file given by hand."""
    left, right = readers.command_index(spark, left_index), readers.command_index(spark, right_index)
    tables = readers.difference_tables(spark, folder, readers.section_index(spark, sections))
    by_hand = readers.derived_rows(spark, derived) if derived else spark.createDataFrame([], "ord int, kind string, left string, right string, source string, ref_left string, ref_right string, note string")
    return sinks.write_difference(I.difference_table(tables, by_hand, left, right), out)


def build(spark: SparkSession, docs: DataFrame, step: Callable[[dict], dict]) -> DataFrame:
    """step(document) for each row of a manifest; one that fails is told in its row (name, ok, error) and the others go on."""
    rows = []
    for d in docs.orderBy("ord").collect():  # a manifest names a handful of books
        try:
            step(d.asDict())
            rows.append((d["name"], True, ""))
        except Exception as x:  # noqa: BLE001
            rows.append((d["name"], False, str(x).split("\n")[0][:300]))
    return spark.createDataFrame(rows, "name string, ok boolean, error string")
