"""Bitemporal relations: valid time and record time, both half-open with NULL as open end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_on(on: Column, start: str = "valid_from", end: str = "valid_to", nullable_start: bool = False) -> Column:
    """Whether a row is valid on a date."""
    begun = F.col(start) <= on
    if nullable_start:
        begun = F.col(start).isNull() | begun
    return begun & (F.col(end).isNull() | (F.col(end) > on))


def current(end: str = "rec_to") -> Column:
    return F.col(end).isNull()


def recorded(at: Column) -> Column:
    """Whether a row was on record at a moment."""
    return as_on(at, "rec_from", "rec_to")


def overlapping(first: Column, last: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether a row is valid on any date from first to last."""
    return (F.col(start) <= last) & (F.col(end).isNull() | (F.col(end) > first))


def intervals(df: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each row ends where the next of its key begins."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order; Spark keeps one row a key while it sorts."""
    return df.withColumn("rank__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("rank__ = 1").drop("rank__")


def overlaps(df: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to", *ties: str) -> DataFrame:
    """Rows that begin before an earlier row of their key has ended: one pass, no self-join."""
    before = Window.partitionBy(key).orderBy(start, *ties).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31").cast("date")
    reach = F.max(F.coalesce(F.col(end), far)).over(before)
    return df.withColumn("reach", reach).where(F.col(start) < F.col("reach"))


def as_of_join(probes: DataFrame, versions: DataFrame, key: str, at: str, start: str, value: list[str]) -> DataFrame:
    """Each probe with the last version of its key that began on or before it.

    Both sides are united and the last version seen is carried forward, so the work is one sort for each key and grows
    with the rows, not with their pairs.
    """
    carried = F.struct(start, *value)
    left = probes.select(F.col(key).alias("key__"), F.col(at).alias("at__"), F.lit(1).alias("side__"), F.struct("*").alias("probe__"), F.lit(None).cast(versions.select(carried).schema[0].dataType).alias("version__"))
    right = versions.select(F.col(key).alias("key__"), F.col(start).alias("at__"), F.lit(0).alias("side__"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("probe__"), carried.alias("version__"))
    order = Window.partitionBy("key__").orderBy("at__", "side__").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("found__", F.last("version__", ignorenulls=True).over(order)).where("side__ = 1")
    return found.select("probe__.*", *[F.col(f"found__.{c}").alias(c) for c in (start, *value)])


def valid_or_latest(probes: DataFrame, versions: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """Each probe with the value valid on its date, else the latest value of its key."""
    newest = versions.groupBy(key).agg(F.max_by(value, "valid_from").alias("newest"))
    hit = as_of_join(probes, versions, key, on, "valid_from", ["valid_to", value])
    valid = F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(on)))
    joined = hit.join(newest, key, "left")
    return joined.select(*probes.columns, F.when(valid, F.col(value)).otherwise(F.col("newest")).alias(value), F.when(valid, "valid").when(F.col("newest").isNotNull(), "latest").otherwise("none").alias("found"))
