"""Words of a page into columns, lines and paragraphs, and the margins that repeat. One page is one group everywhere.

words: page, x0, x1, top, bottom, text; page size given as width and height columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

LINE_GAP, MARGIN, GUTTER = 3.0, 0.08, 0.02


def upright(chars: DataFrame) -> DataFrame:
    """Characters that are not drawn at an angle (matrix entries m1, m2)."""
    return chars.where((F.abs("m1") < 0.1) & (F.abs("m2") < 0.1))


def gutters(words: DataFrame) -> DataFrame:
    """(page, gutter): the middle of the widest gap between word spans in the middle band, of at least 2 % of the width.

    At least three words must stand on either side and 70 % of the words must be clear of it.
    """
    middle = words.where((F.col("x1") > 0.35 * F.col("width")) & (F.col("x0") < 0.65 * F.col("width")) & ((F.col("x1") - F.col("x0")) < 0.5 * F.col("width")))
    reach = F.max("x1").over(Window.partitionBy("page").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    gaps = middle.withColumn("reach", reach).where((F.col("x0") - F.col("reach") >= GUTTER * F.col("width")) & F.col("reach").between(0.35 * F.col("width"), 0.65 * F.col("width")))
    widest = gaps.groupBy("page").agg(F.max_by((F.col("x0") + F.col("reach")) / 2, F.col("x0") - F.col("reach")).alias("gutter"))
    sides = words.join(widest, "page").groupBy("page", "gutter").agg(
        F.count(F.when(F.col("x1") <= F.col("gutter"), 1)).alias("left"), F.count(F.when(F.col("x0") >= F.col("gutter"), 1)).alias("right"), F.count("*").alias("n"),
    )
    return sides.where((F.col("left") >= 3) & (F.col("right") >= 3) & (F.col("left") + F.col("right") >= 0.7 * F.col("n"))).select("page", "gutter")


def lines(words: DataFrame) -> DataFrame:
    """(page, column, line, top, bottom, height, text): words by column, each within LINE_GAP points of its line's first word."""
    placed = words.join(gutters(words), "page", "left").withColumn("column", F.when((F.col("x0") + F.col("x1")) / 2 >= F.col("gutter"), 1).otherwise(0))
    rows = placed.select("page", "column", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), F.col("x0").cast("double").alias("x0"), "text", F.col("height").cast("double").alias("height"))

    def grouped(key: tuple, own: Iterator[tuple]) -> Iterator[tuple]:
        def told(number: int, line: list[tuple]) -> tuple:
            return (*key, number, line[0][2], max(w[3] for w in line), line[0][6], " ".join(w[5] for w in sorted(line, key=lambda w: w[4])))

        line: list[tuple] = []
        number = 0
        for word in own:
            if not line or word[2] - line[0][2] > LINE_GAP:
                if line:
                    yield told(number, line)
                line, number = [], number + 1
            line.append(word)
        yield told(number, line)

    kind = words.schema["page"].dataType.simpleString()
    return folded(rows, ["page", "column"], ["top", "x0"], grouped, f"page {kind}, column int, line int, top double, bottom double, height double, text string")


def paragraphs(rows: DataFrame) -> DataFrame:
    """Lines joined until a gap of over one and a half median line heights, a numbered start or a heading."""
    tall = rows.groupBy("page", "column").agg(F.median(F.col("bottom") - F.col("top")).alias("tall"))
    order = Window.partitionBy("page", "column").orderBy("line")
    heading = (F.length("text") < 80) & F.col("text").rlike("[A-Za-z]") & (F.upper("text") == F.col("text"))
    marked = rows.join(tall, ["page", "column"]).withColumn("heading", heading)
    breaks = (F.col("top") - F.lag("bottom").over(order) > 1.5 * F.col("tall")) | F.col("text").rlike(r"^\(?([0-9]{1,3}|[a-z]{1,3})[.)]\s") | F.col("heading") | F.lag("heading").over(order)
    numbered = marked.withColumn("para", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(order))
    out = numbered.groupBy("page", "column", "para").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("parts"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.max(F.col("heading").cast("int")).alias("h"))
    return out.select("page", "column", "para", "top", "bottom", F.when(F.col("h") == 1, "heading").otherwise("para").alias("kind"), F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))


def repeated_margins(rows: DataFrame, document: str = "doc") -> DataFrame:
    """(document, key, pages): lines near the top or bottom, digits masked, that stand on at least three pages of a document and half of them."""
    zone = F.when(F.col("top") < MARGIN * F.col("height"), "top").when(F.col("bottom") > (1 - MARGIN) * F.col("height"), "bottom")
    keyed = rows.withColumn("zone", zone).where("zone is not null").withColumn("key", F.concat_ws(":", "zone", F.lower(F.regexp_replace("text", "[0-9]+", "#"))))
    pages = rows.groupBy(document).agg(F.countDistinct("page").alias("all_pages"))
    votes = keyed.groupBy(document, "key").agg(F.countDistinct("page").alias("pages"))
    return votes.join(pages, document).where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("all_pages") / 2))).select(document, "key", "pages")
