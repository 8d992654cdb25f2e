"""Command indexes: writing their rows, prefix lookups, differences of two series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import commands as C
from quire.functions import text as T


def lookup(texts: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """For each row (key, text) the best row (ord, command, source) of the index, or none.

    One keyword list must be a prefix of the other, over two words at least or the whole of both; the longest common part wins,
    then the smallest ord. So the whole of either list equals a prefix of the other: two equi-joins on prefixes,
    linear in the inputs, and the best row is an aggregation. Of index rows under one prefix only the first can win, so the index has one row for each.
    """
    want = texts.select(key, C.keywords(F.col("text")).alias("k")).where(F.size("k") > 0)
    have = index.select("ord", "command", "source", C.keywords(F.col("command")).alias("k")).where(F.size("k") > 0)
    words = lambda n: F.array_join(F.slice("k", F.lit(1), n), " ")
    first = lambda df: df.groupBy("p", "n").agg(F.min(F.struct("ord", "command", "source")).alias("row"))
    whole = lambda df, *c: df.select(*c, F.size("k").alias("n"), words(F.size("k")).alias("p"))
    shorter = F.when(F.size("k") > 2, F.sequence(F.lit(2), F.size("k") - 1)).otherwise(F.array().cast("array<int>"))
    longer = first(have.withColumn("n", F.explode(shorter)).select("ord", "command", "source", "n", words(F.col("n")).alias("p")))
    over = want.select(key, "k", F.size("k").alias("w"), F.explode(F.sequence(F.lit(1), F.size("k"))).alias("n")).where("n >= 2 or n = w").select(key, "n", words(F.col("n")).alias("p"))
    cols = [key, "n", "row"]
    both = over.join(first(whole(have, "ord", "command", "source")), ["p", "n"]).select(cols).unionByName(whole(want, key).join(longer, ["p", "n"]).select(cols))
    best = both.groupBy(key).agg(F.min_by(F.struct("row.command", "row.source", "n"), F.struct(-F.col("n"), F.col("row.ord"))).alias("b")).select(key, "b.*")
    return texts.select(key, "text").join(best, key, "left")


def set_diff(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """Families of the left index (ord, command, source) of which the right one has nothing and that known.command doesn't name: (family, n, example, source)."""
    fam = left.select("ord", "command", "source", C.family(F.col("command")).alias("family")).where("family <> ''")
    count = fam.groupBy("family").agg(F.count("*").alias("n"), F.min_by("command", "ord").alias("example"), F.min_by("source", "ord").alias("source"))
    k = C.keywords(F.col("command"))
    there = right.select(F.explode(F.transform(k, lambda x, i: F.array_join(F.slice(k, F.lit(1), i + 1), " "))).alias("family")).distinct()
    told = known.select(C.family(F.col("command")).alias("family")).distinct()
    return count.join(there, "family", "left_anti").join(told, "family", "left_anti")


DIFFERENCE_COLUMNS = ("kind", "left", "right", "source", "ref_left", "ref_right", "note")


def absent_rows(diff: DataFrame) -> DataFrame:
    """set_diff() as rows of the difference table."""
    note = F.format_string("%d commands of the left index are missing on the right, such as %s", F.col("n"), F.col("example"))
    return diff.select(F.lit("absent").alias("kind"), F.concat("family", F.lit(" *")).alias("left"), F.lit("").alias("right"), F.lit("setdiff").alias("source"), F.concat(F.lit("crm:"), "source").alias("ref_left"), F.lit("").alias("ref_right"), note.alias("note"))


# Header cells of the difference tables, in order of preference.
COLUMNS = {"function": ("機能", "コマンドの機能"), "command": ("設定コマンド", "対象コマンド"), "left": ("IXシリーズ",), "right": ("IX-Rシリーズ",), "change": ("IXシリーズからの変更内容",), "note": ("備考", "補足")}


def table_rows(tables: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the difference table from tables (table_id, kind, ref, rows array<array<string>>); the first row names the columns.

    A row has a command or several, choices opened. removed: the command that the text says it became; renamed: the matching or
    else the last line of the right cell; others: the same command.
    """
    head = F.get("rows", F.lit(0))
    where = lambda names: F.coalesce(*(F.nullif(F.array_position(head, n), F.lit(0).cast("long")) for n in names))
    t = tables.where(F.size("rows") >= 2).withColumns({f"_{k}": where(v) for k, v in COLUMNS.items()})
    swap = F.col("_command").isNull() & (F.col("kind") == "renamed")
    t = t.withColumns({"_command": F.when(swap, F.col("_left")).otherwise(F.col("_command")), "_left": F.when(~swap, F.col("_left"))}).where("_command is not null")
    t = t.select("table_id", "kind", "ref", *(f"_{k}" for k in COLUMNS), F.posexplode(F.slice("rows", F.lit(2), F.size("rows") - 1)).alias("row_no", "row"))
    cell = lambda k: F.coalesce(F.get("row", F.col(f"_{k}").cast("int") - 1), F.lit(""))
    t = t.withColumns({k: cell(k) for k in COLUMNS})
    t = t.withColumns({"rights": C.cell_lines(F.col("right")), "opened": F.flatten(F.transform(C.cell_lines(F.col("command")), lambda x: C.open_alternatives(x)))})
    t = t.select("*", F.posexplode("opened").alias("i", "one"))
    target = (
        F.when(F.col("kind") == "removed", T.trim(F.regexp_extract("right", C.UNIFIED, 1)))
        .when(F.col("kind") == "renamed", F.coalesce(F.get("rights", F.col("i")), F.get("rights", F.size("rights") - 1), F.lit("")))
        .otherwise(F.col("one"))
    )
    some = lambda *c: F.array_join(F.filter(F.array(*c), lambda x: x != ""), "。")
    note = (
        F.when(F.col("kind") == "removed", some(F.col("function"), F.concat(F.lit("IX-R: "), F.col("right"))))
        .when(F.col("kind") == "renamed", some(F.col("function"), F.col("note")))
        .when(F.col("kind") == "moved", some(F.col("function"), F.concat(F.lit("モード: "), F.col("left"), F.lit(" → "), F.col("right"))))
        .otherwise(some(F.col("function"), F.col("change"), F.col("note")))
    )
    out = t.select("table_id", "row_no", "i", "kind", "one", target.alias("target"), note.alias("note_"), F.col("ref"), F.concat_ws("/", "table_id", "row_no", "i").alias("id"))
    found = lookup(out.select("id", F.col("one").alias("text")), index).select("id", F.col("source").alias("found"))
    return out.join(found, "id").select("table_id", "row_no", "i", "kind", F.col("one").alias("left"), F.col("target").alias("right"), F.lit("ch8").alias("source"), F.when(F.col("found").isNotNull(), F.concat(F.lit("crm:"), "found")).otherwise("").alias("ref_left"), F.when(F.col("ref") != "", F.concat(F.lit("fd:"), "ref")).otherwise("").alias("ref_right"), F.col("note_").alias("note"))


def difference_table(tables: DataFrame, derived: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Table rows, then derived rows, then absent families that neither names; `part` and `ord` keep that order."""
    own = table_rows(tables, left)
    a = own.select(F.lit(1).alias("part"), F.concat_ws("/", F.lpad("table_id", 8, "0"), F.lpad("row_no", 6, "0"), F.lpad("i", 4, "0")).alias("ord"), *DIFFERENCE_COLUMNS)
    b = derived.select(F.lit(2).alias("part"), F.lpad(F.col("ord").cast("string"), 8, "0").alias("ord"), *DIFFERENCE_COLUMNS)
    told = a.select(F.col("left").alias("command")).unionByName(b.select(F.col("left").alias("command")))
    c = absent_rows(set_diff(left, right, told)).select(F.lit(3).alias("part"), F.col("left").alias("ord"), *DIFFERENCE_COLUMNS)
    return a.unionByName(b).unionByName(c)


def command_rows(entries: DataFrame) -> DataFrame:
    """commands.tsv from entries (entry, title, cmds, file, line, source): one row a command, ordered by command and then by entry."""
    t = entries.select("entry", "title", "file", "line", "source", F.posexplode("cmds").alias("i", "command"))
    return t.orderBy("command", "entry", "i").select("command", F.col("title").alias("entry"), "file", "line", "source")


def section_rows(headings: DataFrame) -> DataFrame:
    """sections.tsv from headings (ord, number, anchor, title, file, line, source): in order, an unnumbered section by its anchor."""
    return headings.orderBy("ord").select(F.coalesce(F.nullif("number", F.lit("")), "anchor").alias("section"), "title", "file", "line", "source")


def slices(index: DataFrame, bodies: DataFrame, needle: str, length: int = 30) -> DataFrame:
    """Body lines of the index rows (file, line, title) whose title holds the needle: from the row's line to the next row's of that file, `length` lines at most."""
    from pyspark.sql import Window

    after = F.lead("line").over(Window.partitionBy("file").orderBy("line"))
    hit = index.withColumn("stop", F.coalesce(after, F.lit(2**31 - 1))).where(F.contains("title", F.lit(needle)))
    hit = hit.where("stop > line").select("file", "title", "line", F.explode(F.sequence("line", F.least("stop", F.col("line") + length) - 1)).alias("line_no"))
    return hit.join(bodies, ["file", "line_no"]).select("file", "title", "line", "line_no", "body")


def named(index: DataFrame, names: DataFrame) -> DataFrame:
    """Index rows whose comma-separated titles hold a name of names.name."""
    t = index.select("*", F.explode(F.split("title", r",\s*")).alias("name"))
    return t.join(names, "name")
