"""Filters, joins, pages, trees and counts over documents, provisions, tasks and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, shares

#: Links that a task is dealt: they are narrow.
LINKS = 1_000_000


def all_of(*clauses: Column | None) -> Column:
    """The conjunction of the clauses that are given."""
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def escaped(needle: str) -> str:
    """A LIKE pattern's literal: backslash, percent and underscore stand for themselves."""
    return "".join("\\" + c if c in "\\%_" else c for c in needle)


def contains(column: str, needle: str) -> Column:
    return F.col(column).ilike(f"%{escaped(needle)}%")


def page_after(df: DataFrame, keys: dict[str, object], limit: int, descending: bool = False) -> DataFrame:
    """The next page in the order of the keys, beyond the last row seen (None: from the start), with one row more to tell."""
    names = list(keys)
    if all(v is not None for v in keys.values()):
        mine = F.struct(*names)
        seen = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in keys.items()])
        df = df.where(mine < seen if descending else mine > seen)
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in names]).limit(limit + 1)


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def first_of_path(asked: DataFrame, paths: DataFrame, path: str, key: str, n: int) -> DataFrame:
    """asked with the first n rows of paths (by key) that have their path, and each one's place.

    All who ask for a path get the same rows, so paths are ranked before the join and it never meets more than n a path.
    """
    return asked.join(top_per_group(paths, path, n, F.asc(key)), path)


def tree_order(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent_id, ordinal) in depth-first order: sort keys are the zero-padded ordinals along the path.

    Each round joins every node to what its highest known ancestor knows, so the known path doubles and a tree of any depth
    takes as many rounds as its depth has binary digits. Nodes that hang from no root, or in a circle, are left out.
    """
    step = F.lpad(F.col("ordinal").cast("string"), 10, "0")
    known = cut(nodes.select("id", "parent_id", F.col("parent_id").alias("top"), step.alias("sort_key"), F.lit(0).alias("depth")))
    done, total = known.where("top is null"), known.count()
    for _ in range(total.bit_length() + 1):
        above = known.select(F.col("id").alias("top"), F.col("top").alias("higher"), F.col("sort_key").alias("before"), F.col("depth").alias("steps"))
        joined = known.where("top is not null").join(above, "top")
        moved = joined.select("id", "parent_id", F.col("higher").alias("top"), F.concat_ws(".", "before", "sort_key").alias("sort_key"), (F.col("depth") + F.col("steps") + 1).alias("depth"))
        known = cut(moved.unionByName(known.where("top is null")))
        done = known.where("top is null")
        if not known.where("top is not null").limit(1).count():
            break
    return done.select("id", "parent_id", "depth", "sort_key")


def _gaps(items: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number, upto): the first and the last number missing between neighbours."""
    after = F.lead(number).over(Window.partitionBy(key).orderBy(number))
    holes = items.select(key, number).distinct().withColumn("after", after).where(F.col("after") > F.col(number) + 1)
    return holes.select(key, (F.col(number) + 1).alias("number"), (F.col("after") - 1).alias("upto"))


def leading_number(label: Column) -> Column:
    """The digits a label begins with, as a number; null where it begins with none."""
    return F.regexp_extract(label, r"^(\d+)", 1).try_cast("long")


def numbering_gaps(labels: DataFrame, key: str, number: str) -> DataFrame:
    """How many numbers are missing between the least and the greatest of each key, and which, as ranges in order."""
    found = labels.groupBy(key).agg(F.min(number).alias("first"), F.max(number).alias("last"))
    range_ = F.struct("number", F.concat(F.col("number").cast("string"), F.when(F.col("upto") > F.col("number"), F.concat(F.lit("-"), F.col("upto").cast("string"))).otherwise("")).alias("said"))
    gaps = _gaps(labels, key, number).groupBy(key).agg(F.sum(F.col("upto") - F.col("number") + 1).alias("n"), F.array_sort(F.collect_list(range_)).alias("gaps"))  # no more ranges than labels
    return found.join(gaps, key, "left").select(key, "first", "last", F.coalesce("n", F.lit(0)).cast("long").alias("n_gaps"), F.coalesce(F.array_join("gaps.said", ","), F.lit("")).alias("gaps"))


def numbering_problems(items: DataFrame, key: str, seq: str, number: str) -> DataFrame:
    """(key, problem, number, upto): numbers given twice, lower than one before, or left out (from one to another)."""
    told = lambda name: [key, F.lit(name).alias("problem"), F.col(number).alias("number"), F.col(number).alias("upto")]
    twice = items.groupBy(key, number).count().where("count > 1").select(*told("duplicate"))
    before = F.lag(number).over(Window.partitionBy(key).orderBy(seq))
    order = items.withColumn("before", before).where(F.col(number) < F.col("before")).select(*told("out_of_order")).distinct()
    return twice.unionByName(order).unionByName(_gaps(items, key, number).select(key, F.lit("gap").alias("problem"), "number", "upto"))


def each_number(problems: DataFrame, step: int = 4096) -> DataFrame:
    """Problems with a row for each number of a range instead of the range; wide ones are cut into pieces first, so that no row holds all of them."""
    pieces = problems.withColumn("number", F.explode(F.sequence("number", "upto", F.lit(step).cast("long"))))
    each = F.sequence("number", F.least(F.col("number") + (step - 1), F.col("upto")))
    return pieces.withColumn("number", F.explode(each)).drop("upto")


def without_chapter(path: Column) -> Column:
    """A provision path without a leading chapter, so that paths with and without one meet in an equi-join."""
    return F.regexp_replace(path, r"^ch[0-9]+\.", "")


def merged_config(given: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of either side by key; stored values win where they are set."""
    a, b = given.alias("a"), stored.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    origin = F.when(F.col(f"a.{key}").isNull(), "stored").when(F.col(f"b.{key}").isNull(), "given").otherwise("both")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns], origin.alias("origin"))


#: Which group a link's type or, failing that, its document's type puts it in.
LINK_GROUPS = {
    "inserts": "amending_instruments", "substitutes": "amending_instruments", "omits": "amending_instruments", "amends": "amending_instruments",
    "mentions": "mentions", "issued_under": "issued_under", "clarifies": "circulars", "interprets": "judgements",
}
TYPE_GROUPS = {"circular": "circulars", "instruction": "circulars", "judgement": "judgements"}


def link_group(link_type: Column, doc_type: Column) -> Column:
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table(LINK_GROUPS), link_type), F.try_element_at(table(TYPE_GROUPS), doc_type), F.lit("other"))


def linked(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links to provisions with their documents, counted by provision and group."""
    own = links.where("dst_type = 'provision'").select("dst_id", "src_id", "link_type")
    tasks = shares(own, LINKS)
    joined = own.repartition(tasks, "src_id").join(docs, F.col("src_id") == F.col("doc_id"))
    each = joined.select("dst_id", "src_id", link_group(F.col("link_type"), F.col("doc_type")).alias("bucket")).repartition(tasks, "dst_id", "src_id").groupBy("dst_id", "bucket", "src_id").agg(F.count("*").alias("links"))
    return each.groupBy("dst_id", "bucket").agg(F.sum("links").alias("links"), F.count("*").alias("documents"))
