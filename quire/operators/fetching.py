"""What to fetch, retry, rebuild and number: the decisions, as tables. Fetching itself is outside this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Statuses that are tried again, attempts, seconds; the series whose books are web pages.
RETRIED = (429, 500, 502, 503, 504)
ATTEMPTS, LONGEST_WAIT = 3, 30
WEB_SERIES = "ix-r"


def retry_delay(status: Column, header: Column, attempt: Column, least: Column, now: Column) -> Column:
    """struct<seconds, error>: 2 << attempt, or for 429 and 503 what the header says, as seconds or as a date; over LONGEST_WAIT it is an error."""
    usual = F.call_function("shiftleft", F.lit(2), attempt)
    told = F.when(F.trim(header).rlike(r"^\d{1,9}\z"), F.trim(header).try_cast("int"))
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(told, F.when(date.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(date) - F.unix_timestamp(now)).cast("int")))
    own = F.when(status.isin(429, 503), wait)
    far = F.coalesce(own > LONGEST_WAIT, F.lit(False))
    return F.struct(F.when(~far, F.greatest(F.coalesce(own, usual), least)).alias("seconds"), F.when(far, F.lit("asked to wait too long")).alias("error"))


def retried(status: Column, attempt: Column) -> Column:
    return status.isin(*RETRIED) & (attempt + 1 < ATTEMPTS)


def fetch_action(status: Column, body: Column, tag: Column, force: Column) -> Column:
    """What an answer means: store, keep (an unchanged page of ours), or an error; `unchanged` counts only with a body, a tag and no force."""
    return F.when(status == 200, F.lit("store")).when(status == 304, F.when(body & tag & ~force, F.lit("keep")).otherwise(F.lit("error: unexpected 304"))).otherwise(F.concat(F.lit("error: status "), status.cast("string")))


def complete_caches(caches: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (book, complete) from caches (book, version, wanted, paths) and files (book, path): the version is the wanted one, and every listed path and index.html is there and local."""
    asked = caches.select("book", F.explode(F.array_union("paths", F.array(F.lit("index.html")))).alias("path"))
    bad = asked.where(F.col("path").rlike(r"^/|(^|/)\.\.(/|\z)")).select("book")
    lost = asked.join(files, ["book", "path"], "left_anti").select("book").union(bad).distinct().withColumn("lost", F.lit(True))
    return caches.join(lost, "book", "left").select("book", ((F.col("version") == F.col("wanted")) & F.col("lost").isNull()).alias("complete"))


def figures_done(marks: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (book, done) from marks (book, sha256, own_sha256, dpi, own_dpi, pages) and files (book, name, size): same source, same resolution, and none of p1.png to pN.png is missing or empty."""
    pages = marks.select("book", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("p")).select("book", F.concat(F.lit("p"), "p", F.lit(".png")).alias("name"))
    lost = pages.join(files.where("size > 0"), ["book", "name"], "left_anti").select("book").distinct().withColumn("lost", F.lit(True))
    return marks.join(lost, "book", "left").select("book", ((F.col("sha256") == F.col("own_sha256")) & (F.col("dpi") == F.col("own_dpi")) & F.col("lost").isNull()).alias("done"))


def figure_pages(files: DataFrame) -> DataFrame:
    """Rows (page, name) from (ord, name): `p-001.png` and the like; the last file of a page wins."""
    n = F.regexp_extract(F.lower("name"), r"^p-?0*(\d+)\.(?:png|jpg|jpeg)\z", 1).try_cast("int")
    return files.withColumn("page", n).where("page > 0").groupBy("page").agg(F.max_by("name", "ord").alias("name"))


def numbered_files(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Files (keys, ord, name) with exactly one run of digits in their base name, in numeric order: (k, name, prefix, suffix, width).

    Numbers have any length: they are compared by length and digits. The pattern is that of the first file.
    """
    base = F.regexp_replace(F.substring_index("name", "/", -1), r"\.[^.]*\z", "")
    digits = F.regexp_extract(base, r"(\d+)", 1)
    t = files.where(F.regexp_count(base, F.lit(r"\d+")) == 1).withColumns({"d": F.regexp_replace(digits, r"^0+(?=\d)", ""), "base": base, "digits": digits})
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.length("d"), "d", "ord")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(all_)
    at = F.instr("base", F.col("digits"))
    t = t.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(all_), "prefix": first(F.substring("base", F.lit(1), at - 1)), "suffix": first(F.substring("base", at + F.length("digits"), F.length("base"))), "digits_": first(F.length("digits"))})
    return t.select(*keys, "k", "name", "prefix", "suffix", F.greatest("digits_", F.length((F.col("n") * 2).cast("string"))).alias("width"))


def page_numbers(spreads: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, k, name, prefix, suffix, width, pages) to one row a page with its running number and name; a file of no pages (it failed) takes no number."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    t = spreads.withColumn("before", F.coalesce(F.sum("pages").over(w), F.lit(0))).where("pages > 0")
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("part")).withColumn("number", (F.col("before") + F.col("part")).cast("int"))
    return t.select(*keys, "name", "part", "number", F.concat("prefix", F.lpad(F.col("number").cast("string"), F.greatest(F.col("width"), F.length(F.col("number").cast("string"))), "0"), "suffix", F.lit(".png")).alias("output"))


def scan_report(results: DataFrame) -> DataFrame:
    """Counters of the rows (status, pages)."""
    return results.agg(F.count_if((F.col("status") == "ok") & (F.col("pages") == 2)).alias("split"), F.count_if((F.col("status") == "ok") & (F.col("pages") == 1)).alias("copied"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("pages"))), F.lit(0)).cast("long").alias("pages"))


def completed_docs(docs: DataFrame) -> DataFrame:
    """Manifest rows with their defaults: kind, profile, version (for a PDF from the query's file name), title, name, in this order."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    file = F.url_decode(F.coalesce(F.try_parse_url("url", F.lit("QUERY"), F.lit("file")), F.lit("")))
    t = docs.withColumn("kind", F.coalesce(empty("kind"), F.when(F.col("series") == WEB_SERIES, F.lit("web")).otherwise(F.lit("pdf"))))
    t = t.withColumn("profile", F.coalesce(empty("profile"), F.concat(F.lit("profiles/"), "series", F.lit("-"), "book", F.lit(".json"))))
    t = t.withColumn("version", F.coalesce(empty("version"), F.when(F.col("kind") == "pdf", F.regexp_extract(file, r"(\d+(?:\.\d+)+[a-z]?)", 1)), F.lit("")))
    t = t.withColumn("title", F.coalesce(empty("title"), F.concat_ws(" ", "series", "book")))
    return t.withColumn("name", F.coalesce(empty("name"), F.concat_ws("-", "series", "book", F.nullif("version", F.lit("")))))


def page_title(html: Column) -> Column:
    """The text of the title element of a well-formed page."""
    return T.collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def image_sources(html: Column) -> Column:
    """The local sources of a page's images, first ones kept."""
    all_ = F.regexp_extract_all(html, F.lit(r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(all_, lambda x: (x != "") & ~F.contains(x, F.lit("://"))))


def search_documents(script: Column) -> Column:
    """The list of page names out of a search index script."""
    return F.from_json(F.regexp_extract(script, r'"?docnames"?\s*:\s*(\[[^\]]*\])', 1), "array<string>")


def web_base(url: Column) -> Column:
    """With a slash at the path's end; null without a URL."""
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    tail = F.substring(url, F.length(path) + 1, F.length(url))
    return F.when(url != "", F.concat(F.regexp_replace(path, r"/+\z", ""), F.lit("/"), tail))
