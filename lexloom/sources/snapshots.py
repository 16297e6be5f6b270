"""Several tables that change at once: each batch writes folders of its own and then one small file that names them.

A reader takes the committed batches as they are when it begins; batches that are being written, or whose writer died,
are not among them. Each commit is a file of its own, so no writer overwrites another's; of two writers at once the order
of their folders' names says which batch is the later one, to every reader alike.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "batch long, tables string, notes string"


class Batch(NamedTuple):
    """A committed batch: its number, its tables' folders and what its writer noted."""

    number: int
    tables: dict[str, str]
    notes: dict


def batches(spark: SparkSession, root: str) -> list[Batch]:
    """The committed batches in order, numbered from 0."""
    try:
        rows = spark.read.schema(_ROW).json(f"{root}/manifest/*").collect()  # a row a batch
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [Batch(k, json.loads(r["tables"]), json.loads(r["notes"])) for k, r in enumerate(sorted(rows, key=lambda r: (r["batch"], r["tables"])))]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], notes: dict | None = None, write: Callable[[str, DataFrame, str], None] | None = None) -> Batch:
    """Write tables into folders of their own and commit them as the next batch."""
    name = uuid.uuid4().hex
    where = {table: f"{root}/data/{name}/{table}" for table in tables}
    for table, df in tables.items():
        write(table, df, where[table]) if write else df.write.parquet(where[table])
    number = len(batches(spark, root))
    row = spark.createDataFrame([(number, json.dumps(where), json.dumps(notes or {}))], _ROW)
    row.coalesce(1).write.mode("error").json(f"{root}/manifest/{number:08d}-{name}")
    return Batch(number, where, notes or {})


def rewrite(spark: SparkSession, root: str, key: str, keys: DataFrame, tables: dict[str, DataFrame], notes: dict | None = None) -> Batch:
    """Replace all rows of some keys in all tables at once; a key without rows in a table has none there from then on."""
    return publish(spark, root, {**tables, f"keys of {key}": keys.select(key).distinct()}, notes)


def current(spark: SparkSession, known: list[Batch], name: str, key: str) -> DataFrame | None:
    """A table's rows, each key's from the last batch that rewrote it."""
    rows = held = None
    for batch in known:
        if name in batch.tables:
            own = spark.read.parquet(batch.tables[name]).withColumn("batch__", F.lit(batch.number))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        if f"keys of {key}" in batch.tables:
            own = spark.read.parquet(batch.tables[f"keys of {key}"]).withColumn("batch__", F.lit(batch.number))
            held = own if held is None else held.unionByName(own)
    if rows is None or held is None:
        return None
    last = held.groupBy(key).agg(F.max("batch__").alias("batch__"))
    return rows.join(last, [key, "batch__"], "left_semi").drop("batch__")
