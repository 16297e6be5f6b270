"""Chunks of documents along their own structure, and the index that keeps a document's last ones current."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens, document_heading, heading_path
from .folds import folded

#: Words at which a chunk of short paragraphs is full, words it may have, characters of a summary, ranks of acts and rules.
FULL, MOST, SUMMARY = 80, 500, 300
RANKS = {"act": 2, "rules": 4}
CHUNK = ["doc_id", "chunk_kind", "chunk_path", "heading_path", "para_label", "first_seq", "last_seq", "text", "tokens"]


def one_each(blocks: DataFrame, kind: str = "other") -> DataFrame:
    """A chunk for each block."""
    return blocks.select("doc_id", F.lit(kind).alias("chunk_kind"), F.col("path").alias("chunk_path"), "text", count_tokens(F.col("text")).alias("tokens"))


def _gathered(blocks: DataFrame, group: Column) -> DataFrame:
    """One row for each group of a document's blocks: texts in order joined by blank lines, and the first block's path and label."""
    rows = blocks.withColumn("group", group).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("text"))))
    first = lambda name: F.min_by(name, "seq")
    return rows.groupBy("doc_id", "group").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), first("path").alias("path"), first("label").alias("label"), first("title").alias("title"))


def notification(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, title, seq, path, label, text): a preamble of all outside numbered paragraphs, and a chunk for each paragraph.

    A paragraph whose first block is an amending unit is an amendment instruction.
    """
    root = F.when(F.col("path").rlike(r"^p[0-9]"), F.substring_index("path", ".", 1)).otherwise("pre")
    got = _gathered(blocks, root)
    label = F.coalesce(F.nullif("label", F.lit("")), "group")
    pre = F.col("group") == "pre"
    kind = F.when(pre, "preamble").when(F.col("path").contains(".i"), "amendment_instruction").otherwise("paragraph")
    heading = F.when(pre, F.concat("title", F.lit(" > Preamble"))).otherwise(document_heading(F.col("title"), F.col("path"), label))
    return got.select("doc_id", kind.alias("chunk_kind"), F.when(pre, "pre").otherwise(F.col("path")).alias("chunk_path"), heading.alias("heading_path"), F.when(~pre, label).alias("para_label"), "first_seq", "last_seq", "text", count_tokens(F.col("text")).alias("tokens"))


def _merged(blocks: DataFrame, keys: list[str], full: int | None, most: int = MOST) -> DataFrame:
    """(keys, first_seq, last_seq, path, labels, text): blocks of a key merged in order.

    A chunk ends when it has `full` words, or would get more than `most`. The rows stream: one chunk is held at a time.
    """
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(*keys, F.col("seq").cast("int").alias("seq"), "path", "label", F.trim("text").alias("text"))
    n = len(keys)

    def body(key: tuple, own: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0

        def told() -> tuple:
            return (*key, held[0][n], held[-1][n], held[0][n + 1], [r[n + 2] for r in held if r[n + 2]], "\n\n".join(r[n + 3] for r in held))

        for row in own:
            words = len(row[n + 3].split())
            if held and ((full is not None and size >= full) or size + words > most):
                yield told()
                held, size = [], 0
            held.append(row)
            size += words
        yield told()

    kinds = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return folded(rows, keys, ["seq"], body, f"{kinds}, first_seq int, last_seq int, path string, labels array<string>, text string")


def circular(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, title, subject, seq, path, label, text): the header as one chunk, and short paragraphs merged, the subject before each."""
    head = F.coalesce("path", F.lit("")).isin("hdr", "pre", "")
    top = _gathered(blocks.where(head), F.lit("hdr"))
    top = top.select("doc_id", F.lit("header").alias("chunk_kind"), F.lit("hdr").alias("chunk_path"), F.concat("title", F.lit(" > Header")).alias("heading_path"), F.lit(None).cast("string").alias("para_label"), "first_seq", "last_seq", "text")
    names = blocks.groupBy("doc_id").agg(F.first("title").alias("title"), F.first("subject").alias("subject"))
    rest = _merged(blocks.where(~head), ["doc_id"], FULL).join(names, "doc_id").withColumn("label", F.try_element_at("labels", F.lit(1)))
    text = F.concat(F.when(F.coalesce("subject", F.lit("")) != "", F.concat(F.lit("Subject: "), "subject", F.lit("\n\n"))).otherwise(""), "text")
    rest = rest.select("doc_id", F.lit("paragraph").alias("chunk_kind"), F.col("path").alias("chunk_path"), document_heading(F.col("title"), F.col("path"), F.col("label")).alias("heading_path"), F.col("label").alias("para_label"), "first_seq", "last_seq", text.alias("text"))
    return top.unionByName(rest).withColumn("tokens", count_tokens(F.col("text")))


def judgement(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, title, seq, path, label, text): the header as one chunk, and within each part paragraphs merged up to MOST words, with the range of their labels."""
    part = F.coalesce(F.nullif(F.substring_index("path", ".", 1), F.lit("")), F.lit("body"))
    rows = blocks.withColumn("part", part)
    top = _gathered(rows.where("part = 'hdr'"), F.lit("hdr"))
    top = top.select("doc_id", F.lit("header").alias("chunk_kind"), F.lit("hdr").alias("chunk_path"), F.concat("title", F.lit(" > Header")).alias("heading_path"), F.lit(None).cast("string").alias("para_label"), "first_seq", "last_seq", "text")
    names = blocks.groupBy("doc_id").agg(F.first("title").alias("title"))
    rest = _merged(rows.where("part <> 'hdr'"), ["doc_id", "part"], None).join(names, "doc_id")
    label = F.when(F.size("labels") > 1, F.concat(F.lit("paras "), F.element_at("labels", 1), F.lit("-"), F.element_at("labels", -1))).otherwise(F.try_element_at("labels", F.lit(1)))
    heading = F.concat_ws(" > ", "title", F.initcap("part"), label)
    rest = rest.select("doc_id", F.col("part").alias("chunk_kind"), F.col("path").alias("chunk_path"), heading.alias("heading_path"), label.alias("para_label"), "first_seq", "last_seq", "text")
    return top.unionByName(rest).withColumn("tokens", count_tokens(F.col("text")))


def of_provisions(versions: DataFrame, rank: int | Column) -> DataFrame:
    """A provision chunk for each version, and a summary for sections and rules with a heading."""
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    named = F.col("heading").isNotNull() & (F.col("heading") != "")
    path = heading_path(F.col("instrument"), F.col("path"), F.col("heading"))
    base = versions.select("version_id", F.lit("provision").alias("chunk_kind"), path.alias("heading_path"), "text", rank.alias("authority_rank"))
    summary = F.concat("heading", F.lit(": "), F.when(F.length("text") > SUMMARY, F.concat(F.substring("text", 1, SUMMARY), F.lit("..."))).otherwise(F.col("text")))
    return base.unionByName(versions.where(named & F.col("level").isin("section", "rule")).select("version_id", F.lit("section_summary").alias("chunk_kind"), path.alias("heading_path"), summary.alias("text"), rank.alias("authority_rank")))


def indexed(stored: DataFrame, chunks: DataFrame, documents: DataFrame, key: str, batch: int) -> DataFrame:
    """The chunk index after a batch: the chunks of documents in it are current, their older ones are not.

    documents (key, doc_type, authority_rank, status, in_force_date, doc_date) give each chunk its type, rank, status and validity.
    """
    about = documents.select(key, "doc_type", "authority_rank", "status", F.coalesce("in_force_date", "doc_date").alias("valid_from"))
    new = chunks.join(about, key).withColumn("batch", F.lit(batch)).withColumn("is_current", F.lit(True))
    touched = chunks.select(key).distinct().withColumn("touched", F.lit(True))
    old = stored.join(touched, key, "left").withColumn("is_current", F.col("is_current") & F.col("touched").isNull()).drop("touched")
    return old.unionByName(new.select(*stored.columns))


def superseded(chunks: DataFrame, key: str, batch: str) -> DataFrame:
    """is_current: whether a chunk is of its document's last batch."""
    newest = chunks.groupBy(key).agg(F.max(batch).alias("newest"))
    return chunks.join(newest, key).withColumn("is_current", F.col(batch) == F.col("newest")).drop("newest")
