"""Folds over ordered lines as window pipelines. Each takes key columns and an order column: order is data, never that of partitions.

The window functions of one operator share keys and order, so a plan has one exchange and one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def exploded(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, line_no, line), numbered from 1. A null text has no lines."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def logical_lines(lines: DataFrame, keys: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Wrapped lines joined: rows (keys, unit, text). A unit ends at a blank line, a sentence's end, or before a bullet or parameter."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = lines.withColumn("_t", T.trim(F.col(line))).withColumn("_before", F.coalesce(F.lag("_t").over(w), F.lit("")))
    opens = (F.col("_t") != "") & ((F.col("_before") == "") | T.starts_unit(F.col("_t")) | T.ends_sentence(F.col("_before")))
    t = t.withColumn("_opens", opens).withColumn("unit", F.sum(F.col("_opens").cast("int")).over(w)).where("_t <> ''")
    piece = F.when(F.col("_opens"), F.col("_t")).otherwise(F.concat(T.joiner(F.col("_before"), F.col("_t")), "_t"))
    return t.groupBy(*keys, "unit").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))).alias("x")).select(*keys, "unit", F.array_join(F.col("x.p"), "").alias("text"))


def fold_blanks(lines: DataFrame, keys: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Single blank lines go; of two or more one stays."""
    w = Window.partitionBy(*keys).orderBy(order)
    blank = T.trim(F.col(line)) == ""
    t = lines.withColumn("_b", blank).withColumns({"_p": F.coalesce(F.lag("_b").over(w), F.lit(False)), "_q": F.coalesce(F.lag("_b", 2).over(w), F.lit(False))})
    return t.where("not _b or (_p and not _q)").drop("_b", "_p", "_q")


def rendered_body(units: DataFrame, keys: list[str], order: str = "unit", text: str = "text") -> DataFrame:
    """Adds `out`: a unit as Markdown. Parameters open a definition, bullets after it are nested, prose ends both."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = F.col(text)
    t = units.withColumn("_k", F.when(T.is_parameter(s), F.lit("p")).when(T.is_bullet(s), F.lit("b")).otherwise(F.lit("t")))
    held = F.last(F.when(F.col("_k") != "b", F.col("_k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumns({"_in": F.coalesce(F.lag("_k").over(w) != "t", F.lit(False)), "_def": F.coalesce(held == "p", F.lit(False))})
    body = F.when(F.col("_k") == "p", F.concat(F.lit("- "), T.inline_markup(s))).when(F.col("_k") == "b", F.concat(F.when(F.col("_def"), F.lit("  ")).otherwise(F.lit("")), F.lit("- "), T.inline_markup(T.strip_bullet(s)))).otherwise(T.inline_markup(s))
    gap = F.when((F.col("_k") == "t") == F.col("_in"), F.lit("\n")).otherwise(F.lit(""))
    return t.withColumn("out", F.concat(gap, body, F.lit("\n"))).drop("_k", "_in", "_def")


def entries(lines: DataFrame, book: str, marker: str, labels: list[str], page: str = "page", order: str = "line_no") -> DataFrame:
    """Entries of a command book from its page lines: rows (book, entry, title, page, field, label, lines).

    Pages with neither a marked line nor a line that is just a label are navigation and are left out. A marked line opens an
    entry, a label a field, which goes on over pages; what follows a label after two spaces is the field's first line.
    """
    w = Window.partitionBy(book).orderBy(page, order)
    t = T.trim(F.col("line"))
    marked = F.startswith(F.col("_t"), F.lit(marker)) if marker else F.lit(False)
    label = F.coalesce(*(F.when((F.col("_t") == x) | F.startswith(F.col("_t"), F.lit(x + "  ")), F.lit(x)) for x in labels))
    rows = lines.withColumn("_t", t).withColumns({"_mark": marked & (F.col("_t") != ""), "_label": label})
    useful = F.max(F.col("_mark") | F.col("_t").isin(*labels)).over(Window.partitionBy(book, page))
    rows = rows.withColumn("_useful", useful).where("_useful")
    rows = rows.withColumn("entry", F.sum(F.col("_mark").cast("int")).over(w)).where("entry > 0")
    we = Window.partitionBy(book, "entry").orderBy(page, order)
    rows = rows.withColumn("field", F.sum((F.col("_label").isNotNull() & ~F.col("_mark")).cast("int")).over(we))
    rows = rows.withColumn("_line", F.when(F.col("_mark"), F.lit(None)).when(F.col("_label").isNotNull(), F.when(F.col("_t") != F.col("_label"), T.trim(F.substring(F.col("_t"), F.length("_label") + 1, F.length("_t"))))).when(F.col("_t") == "", F.lit("")).otherwise(F.col("line")))
    place = F.struct(F.col(page), F.col(order), F.col("_line").alias("line"))
    got = rows.groupBy(book, "entry", "field").agg(F.first(F.when(F.col("_mark"), T.trim(F.substring(F.col("_t"), F.lit(len(marker) + 1), F.length("_t")))), ignorenulls=True).alias("title"), F.min(F.when(F.col("_mark"), F.col(page))).alias("page"), F.first(F.when(~F.col("_mark"), F.col("_label")), ignorenulls=True).alias("label"), F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), place))).alias("x"))
    head = got.where("title is not null").select(book, "entry", "title", "page")
    body = got.where("field > 0").select(book, "entry", "field", T.normalize_label(F.col("label")).alias("label"), F.col("x.line").alias("lines"))
    return head.join(body, [book, "entry"], "left")


def filled_down(rows: DataFrame, keys: list[str], order: str, column: str, empty="") -> DataFrame:
    """An empty value takes the last one before it that isn't."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.coalesce(F.last(F.nullif(F.col(column), F.lit(empty)), ignorenulls=True).over(w), F.lit(empty)))


def item_lines(items: DataFrame, keys: list[str], order: str, text: str = "text", first: int = 3) -> DataFrame:
    """Adds `line`: the line at which each item starts in the file that its key's items make up."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    return items.withColumn("line", F.lit(first) + F.coalesce(F.sum(ends).over(w), F.lit(0)))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Groups with their size and the place of their first row, which orders them."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first_seen"), F.count("*").alias("n"))


def last_wins(rows: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """The value of each key's last row."""
    by = F.struct(*([order] if isinstance(order, str) else order))
    return rows.groupBy(*keys).agg(F.max_by(value, by).alias(value))


def chapter_titles(pages: DataFrame, book: str) -> DataFrame:
    """Rows (book, chapter, title) from the pages (book, page, printed, full_lines): of pages printed `n-1` the first line `n. title`; a later page wins."""
    one = pages.where(F.endswith("printed", F.lit("-1"))).withColumn("chapter", T.chapter_of(F.col("printed"))).where("chapter > 0")
    found = F.filter(F.transform("full_lines", T.trim), lambda x: F.regexp_extract(x, r"^(\d+)\.", 1).try_cast("int") == F.col("chapter"))
    one = one.withColumn("title", F.regexp_extract(F.get(F.filter(found, lambda x: x.rlike(r"^\d+\.\s*\S")), F.lit(0)), r"^\d+\.\s*(\S.*?)\s*\z", 1))
    return last_wins(one.where("title is not null and title <> ''"), [book, "chapter"], "page", "title")


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper middle of the sorted values, without interpolation. Values are counted first, so equal ones cost a row once."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    total = Window.partitionBy(*keys)
    t = counted.withColumns({"_upto": F.sum("n").over(w), "_all": F.sum("n").over(total)})
    return t.where("_upto > floor(_all / 2)").groupBy(*keys).agg(F.min(value).alias("median"))


def mode(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The most frequent value, the larger of ties."""
    counted = rows.select(*keys, value.alias(name)).groupBy(*keys, name).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("n", name)).alias("m")).select(*keys, F.col(f"m.{name}").alias(name), F.col("m.n").alias("n"))


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers: rows (keys, start, stop, size)."""
    w = Window.partitionBy(*keys).orderBy(value)
    t = rows.select(*keys, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w))
    return t.groupBy(*keys, "_g").agg(F.min(value).alias("start"), F.max(value).alias("stop"), F.count("*").alias("size")).drop("_g")
