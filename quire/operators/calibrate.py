"""Calibrating a book's page geometry from its glyph rows (page, lo, hi, top, bottom): aggregations over integer positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.lines import islands

#: Fewer glyphs than this in the first pages mean that there is no text layer.
LEAST_GLYPHS, FIRST_PAGES, FULL_PAGE = 200, 20, 300


def occupied(glyphs: DataFrame) -> DataFrame:
    """Rows (x, n): how many pages use the integer position x, each page once."""
    t = glyphs.select("page", F.explode(F.sequence(F.floor("lo").cast("int"), F.ceil("hi").cast("int"))).alias("x")).distinct()
    return t.groupBy("x").agg(F.count("*").alias("n"))


def widest_empty(counts: DataFrame, pages: int, left: int, right: int) -> DataFrame:
    """The first longest run, two positions at least, of the middle half of left..right that a tenth of the pages at most use."""
    spark = counts.sparkSession
    width = right - left
    middle = spark.range(left + width // 4, right - width // 4 + 1).select(F.col("id").cast("int").alias("x"))
    quiet = middle.join(counts, "x", "left").where(F.coalesce("n", F.lit(0)) <= pages // 10).withColumn("k", F.lit(1))
    return islands(quiet, ["k"], "x").where("size >= 2").orderBy(F.desc("size"), "start").limit(1).select("start", "stop", "size")


def text_layer(glyphs: DataFrame, pages: int = FIRST_PAGES) -> DataFrame:
    """One row: glyphs of the first pages, and whether they are enough."""
    return glyphs.where(F.col("page") <= pages).agg(F.count("*").alias("glyphs")).withColumn("has_text", F.col("glyphs") >= LEAST_GLYPHS)


def sample_pages(glyphs: DataFrame, windows: int, length: int) -> DataFrame:
    """Rows (window, first, last): evenly spaced windows of pages over the middle 15 to 85 per cent of the full pages; overlapping ones are skipped."""
    full = glyphs.groupBy("page").agg(F.count("*").alias("n")).where(F.col("n") > FULL_PAGE).select("page")
    at = full.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("page")) - 1, "all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    lo, hi = F.floor(F.col("all") * 0.15), F.ceil(F.col("all") * 0.85)
    step = F.greatest(F.lit(1), F.floor((hi - lo) / windows))
    pick = at.where((F.col("i") >= lo) & (F.col("i") < hi) & ((F.col("i") - lo) % step == 0)).withColumn("window", F.floor((F.col("i") - lo) / step)).where(F.col("window") < windows)
    before = F.lag("page").over(Window.partitionBy(F.lit(1)).orderBy("page"))
    return pick.withColumn("before", before).where(F.col("before").isNull() | (F.col("page") > F.col("before") + length - 1)).select("window", F.col("page").alias("first"), (F.col("page") + length - 1).alias("last"))


def running_band(glyphs: DataFrame, height: int, edge: str = "top") -> DataFrame:
    """The first even margin at which the number of glyphs outside it is under that of the whole page and no longer changes.

    glyphs: rows with `top` and `bottom`, measured from the page's foot. One pass counts glyphs by the margin that drops them.
    """
    gap = (F.lit(height) - (F.col("top") + F.col("bottom")) / 2) if edge == "top" else (F.col("top") + F.col("bottom")) / 2
    lost = glyphs.select((F.floor(gap / 2) * 2 + 2).cast("int").alias("m")).groupBy("m").agg(F.count("*").alias("lost"))
    margins = glyphs.sparkSession.range(2, height // 4 + 1, 2).select(F.col("id").cast("int").alias("m"))
    w = Window.partitionBy(F.lit(1)).orderBy("m")
    t = margins.join(lost, "m", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    t = t.withColumn("gone", F.sum("lost").over(w)).withColumn("before", F.lag("gone").over(w))
    return t.where("gone > 0 and gone = before").agg(F.min("m").alias("margin"))


def gutter(glyphs: DataFrame, pages: int, left: int, right: int, slack: float = 3.0) -> DataFrame:
    """The empty band's middle, with the glyphs wholly to its left and right; no row where a side is empty or one in a hundred glyphs lies across."""
    band = widest_empty(occupied(glyphs), pages, left, right).select(((F.col("start") + F.col("stop")) / 2).alias("middle"))
    t = glyphs.crossJoin(F.broadcast(band))  # the band is one row
    t = t.groupBy("middle").agg(F.count_if(F.col("hi") <= F.col("middle") + slack).alias("left"), F.count_if(F.col("lo") >= F.col("middle") - slack).alias("right"), F.count("*").alias("all"))
    return t.where((F.col("left") > 0) & (F.col("right") > 0) & (F.abs(F.col("all") - F.col("left") - F.col("right")) * 100 <= F.col("all")))
