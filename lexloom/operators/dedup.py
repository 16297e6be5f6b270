"""Exact and near duplicates of documents, and where their versions go."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def exact_groups(docs: DataFrame) -> DataFrame:
    """(digest, n, first): texts that occur more than once."""
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@F.pandas_udf(LongType())
def majority_bits(hashes: pd.Series) -> pd.Series:
    """Of each array of 60-bit numbers, the bits that most of them have."""
    places = np.arange(60)

    def one(own: np.ndarray | None) -> int:
        values = np.asarray(own if own is not None else [], dtype=np.int64)
        ones = sum((((values[k : k + 4096, None] >> places) & 1).sum(axis=0) for k in range(0, len(values), 4096)), np.zeros(60, dtype=np.int64))
        return int(((2 * ones > len(values)).astype(np.int64) << places).sum())

    return hashes.map(one)


def hashed_bits(docs: DataFrame) -> DataFrame:
    """doc_id and simhash: a 60-bit similarity hash of distinct words, from the first bits of their MD5.

    Copies of a text are hashed once, and documents are joined to that by the text's digest: a join, so that Spark can
    split a text that very many documents share.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    texts = keyed.groupBy("key").agg(F.min("text").alias("text"))
    found = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda x: x != ""))
    value = lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("long")
    made = texts.select("key", majority_bits(F.transform(found, value)).alias("simhash"))
    return keyed.select("doc_id", "key").join(made, "key").select("doc_id", "simhash")


def class_pairs(hashes: DataFrame, block: str, distance: int = 3, parts: int = 6, bits: int = 64) -> DataFrame:
    """(block, sx, sy, a, b, distance): two hashes of one block that differ in at most `distance` bits, and the least document of each; a < b.

    Hashes are cut into parts. Differing bits stand in at most `distance` of them, so two hashes agree in all the others:
    every choice of parts - distance parts is a key of an equi-join (20 keys of 32 bits for six parts), and hashes that only
    look alike by chance seldom meet.
    """
    cuts = [bits * k // parts for k in range(parts + 1)]
    part = [F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [F.xxhash64(*[part[k] for k in chosen]) for chosen in combinations(range(parts), parts - distance)]
    classes = hashes.groupBy(block, "simhash").agg(F.min("doc_id").alias("a"))
    banded = classes.select(block, "simhash", "a", F.posexplode(F.array(*keys)).alias("band", "value"))
    x, y = banded.alias("x"), banded.alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (block, "band", "value")]).where("x.a < y.a")
    apart = F.bit_count(F.col("x.simhash").bitwiseXOR(F.col("y.simhash")))
    return met.where(apart <= distance).select(F.col(f"x.{block}").alias(block), F.col("x.simhash").alias("sx"), F.col("y.simhash").alias("sy"), F.col("x.a").alias("a"), F.col("y.a").alias("b"), apart.alias("distance")).distinct()


def near_pairs(hashes: DataFrame, block: str, distance: int = 3) -> DataFrame:
    """(a, b): documents of one block whose hashes differ in at most `distance` bits.

    Equal hashes are one class first: a class stands for its members in the join, and members pair with the class only.
    """
    classes = hashes.groupBy(block, "simhash").agg(F.min("doc_id").alias("a"))
    copies = hashes.join(classes, [block, "simhash"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("distance"))
    return class_pairs(hashes, block, distance).select("a", "b", "distance").unionByName(copies)


def merge_targets(hashes: DataFrame, docs: DataFrame, block: str, number: str) -> DataFrame:
    """(doc_id, target): a document goes to the earliest one near it that has its number.

    Each class has the least document of each number; a class takes the least of its own and all near classes, so every
    near document counts and no pairs of documents are made.
    """
    members = hashes.join(docs.select("doc_id", F.col(number).alias("number")), "doc_id").where("number is not null")
    least = members.groupBy(block, "simhash", "number").agg(F.min("doc_id").alias("target"))
    near = class_pairs(hashes, block).select(block, "sx", "sy")
    both = near.unionByName(near.select(block, F.col("sy").alias("sx"), F.col("sx").alias("sy")))
    lent = both.join(least.withColumnRenamed("simhash", "sy"), [block, "sy"]).select(block, F.col("sx").alias("simhash"), "number", "target")
    best = least.unionByName(lent).groupBy(block, "simhash", "number").agg(F.min("target").alias("target"))
    return members.join(best, [block, "simhash", "number"]).where("target < doc_id").select("doc_id", "target")


def renumbered(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, doc_id, version_no): versions under their target, from 1 in the order of doc_id."""
    moved = docs.select("doc_id").join(targets, "doc_id", "left").withColumn("target", F.coalesce("target", "doc_id"))
    return moved.withColumn("version_no", F.row_number().over(Window.partitionBy("target").orderBy("doc_id")))


def word_recall(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Of each text, the share of expected words (with repeats) that were found."""
    count = lambda df, n: df.select(key, F.explode(F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda x: x != "")).alias("word")).groupBy(key, "word").agg(F.count("*").alias(n))
    joined = count(expected, "want").join(count(found, "have"), [key, "word"], "left")
    return joined.groupBy(key).agg(F.sum("want").alias("want"), F.sum(F.least("want", F.coalesce("have", F.lit(0)))).alias("have")).withColumn("recall", F.round(F.col("have") / F.col("want"), 6))


def numbers_of(*names: Column) -> Column:
    """The numbers a document goes by: those that are given and not blank, trimmed and small, once each."""
    said = F.transform(F.array_compact(F.array(*names)), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(said, lambda x: x != ""))


def sharing(docs: DataFrame, block: str, key: str, numbers: str) -> DataFrame:
    """(block, number, key, target): documents of one block that share a number, each with the least of them; a row for each document and number."""
    each = docs.select(block, key, F.explode(F.array_distinct(numbers)).alias("number"))
    least = each.groupBy(block, "number").agg(F.min(key).alias("target"), F.max(key).alias("most")).where("target < most").drop("most")
    return each.join(least, [block, "number"]).select(block, "number", key, "target").distinct()


def sharing_pairs(docs: DataFrame, block: str, key: str, numbers: str) -> DataFrame:
    """(a, b): every two documents of one block that have a number in common, once each, from the members of each number that is shared."""
    members = sharing(docs, block, key, numbers).select(block, "number", key)
    a, b = members.select(block, "number", F.col(key).alias("a")), members.select(block, "number", F.col(key).alias("b"))
    return a.join(b, [block, "number"]).where("a < b").select("a", "b").distinct()
