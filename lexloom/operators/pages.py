"""Pages of documents: what is kept of each, which are problems, and what goes into and comes out of reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import mismatch

#: How much garbled text, difference between engines and doubt of a reader flags a page; letters for a point that count as text.
GARBLE, MARGIN, LEAST_OCR, DENSITY = 0.15, 0.05, 0.6, 0.0005
ERROR_LENGTH, PAGE_TEXT, BLOCKS_PER_PAGE = 500, 5000, 20


def needs_ocr(chars: Column, width: Column, height: Column, least: float = DENSITY) -> Column:
    """Whether a page has too few characters for its size to be text."""
    return chars / (width * height) < least


def decided(pages: DataFrame) -> DataFrame:
    """pages (chars_a, chars_b, garble, ocr_conf, error, thin) with method, status and the reason of a flag, the first that holds.

    A page that raised an error or has no text is failed; nothing else of its document is lost.
    """
    failed = F.col("error").isNotNull() | (F.coalesce(F.greatest("chars_a", "chars_b"), F.lit(0)) == 0)
    ocr = F.col("ocr_conf").isNotNull()
    differs = F.col("chars_a").isNotNull() & F.col("chars_b").isNotNull() & mismatch(F.col("chars_a"), F.col("chars_b"), MARGIN)
    reason = (
        F.when(F.col("error").isNotNull(), "error").when(failed, "no_text").when(ocr & (F.col("ocr_conf") < LEAST_OCR), "low_ocr_confidence")
        .when(F.col("garble") > GARBLE, "garbled").when(~ocr & differs, "cross_check_mismatch")
    )
    method = F.when(failed, "failed").when(ocr, "ocr").otherwise("text")
    status = F.when(failed, "failed").when(reason.isNotNull(), "flagged").otherwise("ok")
    return pages.select("*", method.alias("method"), status.alias("status"), reason.alias("reason"), F.substring("error", 1, ERROR_LENGTH).alias("error_text"))


def accounted(pages: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """(key, page_count, n, whole): whether each version (key, page_count) has one row for each of its pages, numbered from 1."""
    rows = pages.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("page_no").alias("numbers"), F.min("page_no").alias("least"), F.max("page_no").alias("most"))
    joined = versions.join(rows, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = (F.col("n") == F.col("page_count")) & ((F.col("n") == 0) | ((F.col("numbers") == F.col("n")) & (F.col("least") == 1) & (F.col("most") == F.col("n"))))
    return joined.select(key, "page_count", "n", whole.alias("whole"))


def problems(pages: DataFrame, blocks: DataFrame, key: str, most: int = BLOCKS_PER_PAGE) -> DataFrame:
    """Flagged and failed pages with the ids of their first blocks and the head of their text."""
    order = Window.partitionBy(key, "page_no").orderBy("seq")
    first = blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    own = first.groupBy(key, "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["seq"]).alias("block_seqs"), F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n"), 1, PAGE_TEXT).alias("page_text"))
    return pages.where("status <> 'ok'").join(own, [key, "page_no"], "left").select(key, "page_no", "method", "status", "reason", F.coalesce("block_seqs", F.array().cast("array<int>")).alias("block_seqs"), "page_text")


def ocr_confidence(pages: DataFrame, key: str) -> DataFrame:
    """The mean confidence of each document's pages read from images."""
    return pages.where("method = 'ocr'").groupBy(key).agg(F.round(F.avg("ocr_conf"), 6).alias("ocr_conf"))


def ocr_words(tsv: DataFrame, key: str) -> DataFrame:
    """(key, page text in paragraphs, mean confidence) from a reader's table of tab-separated lines: words are rows of level 5 with a confidence."""
    line = F.split("line", "\t")
    rows = tsv.select(key, "at", line.alias("c")).where((F.size("c") == 12) & (F.try_element_at("c", F.lit(1)) == "5"))
    cell = lambda k: F.col("c")[k].try_cast("double")
    words = rows.select(key, "at", cell(2).alias("block"), cell(3).alias("par"), cell(4).alias("row"), cell(10).alias("conf"), F.trim(F.col("c")[11]).alias("word")).where("conf >= 0 and word <> ''")
    joined = lambda column, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, column))), lambda x: x[column]), " ")
    lines = words.groupBy(key, "block", "par", "row").agg(joined("word", "at").alias("text"), F.min("at").alias("first"), F.sum("conf").alias("conf"), F.count("*").alias("n"))
    pars = lines.groupBy(key, "block", "par").agg(joined("text", "first").alias("text"), F.min("first").alias("first"), F.sum("conf").alias("conf"), F.sum("n").alias("n"))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n\n")
    return pars.groupBy(key).agg(page.alias("text"), F.round(F.sum("conf") / F.sum("n") / 100, 6).alias("ocr_conf"))


def paragraphs_of(pages: DataFrame, key: str) -> DataFrame:
    """Paragraphs of texts at blank lines, in order."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select(key, F.posexplode(parts).alias("seq", "text"))


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words of pages whose middle is in no table's box (page, x0, top, x1, bottom); boxes are few for a page and meet by page."""
    boxes = tables.select("page", F.struct("x0", "top", "x1", "bottom").alias("box")).groupBy("page").agg(F.collect_list("box").alias("boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = F.exists(F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)), lambda b: x.between(b["x0"], b["x1"]) & y.between(b["top"], b["bottom"]))
    return words.join(boxes, "page", "left").where(~inside).drop("boxes")


def percent_box(box: dict[str, Column], width: Column, height: Column) -> Column:
    """A box in percent of its page, within it; null where it has no area."""
    part = lambda value, size: F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * value / size))
    made = F.struct(part(box["x0"], width).alias("left"), part(box["top"], height).alias("top"), part(box["x1"] - box["x0"], width).alias("width"), part(box["bottom"] - box["top"], height).alias("height"))
    return F.when((width > 0) & (height > 0) & (box["x1"] > box["x0"]) & (box["bottom"] > box["top"]), made)


def first_page(blocks: DataFrame, provisions: DataFrame, key: str) -> DataFrame:
    """The least page of the blocks that a provision (key, block_ids) came from."""
    return provisions.select(key, F.explode("block_ids").alias("block_id")).join(blocks.select("block_id", "page"), "block_id").groupBy(key).agg(F.min("page").alias("page"))
