"""A global order by doc_id without a single sorted partition: buckets by quantiles, and a carried row between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

BUCKET, CARRIED = "bucket__", "carried__"


def bounds_of(docs: DataFrame, buckets: int) -> list[int]:
    """At most buckets - 1 ascending doc_ids that cut the rows into buckets of about equal size; ids are whole numbers."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number to be ordered")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("q")).first()["q"] if buckets > 1 else []
    return sorted(set(cuts or []))


def bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds below or at doc_id, by binary search; a null id is in the first bucket. Only ids reach Python."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(IntegerType())
    def place(ids: pd.Series) -> pd.Series:
        null = ids.isna()
        at = np.searchsorted(cuts, ids.fillna(0).astype("int64"), side="right")
        return pd.Series(np.where(null, 0, at), dtype="int32")

    return place(doc_id.cast("long"))


def _carry(doc_id: Column, carry: dict[int, int], null: int | None) -> Column:
    """The bucket to which a row is carried too, else null."""
    ids = np.array(sorted(carry), dtype=np.int64)
    targets = np.array([carry[i] for i in sorted(carry)], dtype=np.int64)

    @F.pandas_udf(StructType([StructField("to", IntegerType())]))
    def target(doc_ids: pd.Series) -> pd.DataFrame:
        plain = doc_ids.fillna(0).astype("int64").to_numpy()
        at = np.minimum(np.searchsorted(ids, plain), max(0, len(ids) - 1))
        hit = (ids[at] == plain) if len(ids) else np.zeros(len(plain), dtype=bool)
        to = pd.Series(np.where(hit, targets[at] if len(ids) else 0, -1), dtype="int32")
        to[doc_ids.isna().to_numpy()] = -1 if null is None else null
        return pd.DataFrame({"to": to})

    to = target(doc_id.cast("long"))["to"]
    return F.when(to >= 0, to)


def with_previous(docs: DataFrame, buckets: int) -> tuple[DataFrame, list[int]]:
    """docs with BUCKET and CARRIED: each bucket also gets the last rows of the bucket before it (the first: of the last).

    Sorted within a bucket by (CARRIED descending, doc_id), the row before a row is its neighbour in the global order.
    Only the bounds and one doc_id for each bucket reach the driver.
    """
    bounds = bounds_of(docs, buckets)
    placed = docs.withColumn(BUCKET, bucket_of(F.col("doc_id"), bounds))
    last = {r[BUCKET]: r["last"] for r in placed.groupBy(BUCKET).agg(F.max("doc_id").alias("last")).collect()}
    filled = sorted(last)
    carry = {last[b]: filled[(k + 1) % len(filled)] for k, b in enumerate(filled)}
    null = carry.pop(None, None)
    to = F.col("to__")
    own = F.struct(F.col(BUCKET).alias("b"), F.lit(False).alias("c"))
    both = F.when(to.isNull(), F.array(own)).otherwise(F.array(own, F.struct(to.alias("b"), F.lit(True).alias("c"))))
    out = placed.withColumn("to__", _carry(F.col("doc_id"), carry, null)).withColumn("place__", F.explode(both))
    return out.withColumn(BUCKET, F.col("place__.b")).withColumn(CARRIED, F.col("place__.c")).drop("place__", "to__"), bounds
