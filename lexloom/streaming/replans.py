"""Amendments that come late: the timelines they touch are replayed as a whole, with record time, batch by batch.

A batch of amendments names its provisions. Their steps so far and the new ones are replayed from the baseline; where the
plan differs from what is on record, the open rows are closed at the batch's time and the planned ones added. Steps and
versions of the touched provisions change at once (`sources.snapshots`), the rest is not read. A batch that is run again
after it was committed does nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import law
from ..session import cut
from ..sources import snapshots

STEP = "provision_id long, amendment_id string, effective_from date, kind string, old_text string, new_text string, anchor_text string, position string, occurrence int"
VERSION = "provision_id long, valid_from date, valid_to date, text string, amendment_id string, rec_from timestamp, rec_to timestamp"
_KEY = "provision_id"


def _now(spark: SparkSession, known: list[snapshots.Batch], name: str, schema: str) -> DataFrame:
    rows = snapshots.current(spark, known, name, _KEY)
    return spark.createDataFrame([], schema) if rows is None else rows


def replan(spark: SparkSession, root: str, baselines: DataFrame, late: DataFrame, at: datetime, number: int, touched: DataFrame | None = None) -> None:
    """Take a batch of amendments (STEP) on record at a time; `touched` names its provisions where it has more than these."""
    known = snapshots.batches(spark, root)
    if any(b.notes.get("batch") == number for b in known):
        return
    touched = (late if touched is None else touched).select(_KEY).where(F.col(_KEY).isNotNull()).distinct()
    own = lambda df: df.join(touched, _KEY, "left_semi")
    names = [c.split()[0] for c in STEP.split(", ")]
    steps = own(_now(spark, known, "steps", STEP)).select(*names).unionByName(late.select(*names)).dropDuplicates([_KEY, "amendment_id"])
    steps = cut(steps)
    planned = cut(law.replayed(own(baselines), steps))
    stored = own(_now(spark, known, "versions", VERSION))
    rows = law.consolidated(stored, planned, F.lit(at).cast("timestamp"))
    snapshots.rewrite(spark, root, _KEY, touched, {"steps": steps, "versions": rows}, {"batch": number})


def begin(spark: SparkSession, root: str, baselines: DataFrame, at: datetime) -> None:
    """Put the baselines on record, as batch -1."""
    replan(spark, root, baselines, spark.createDataFrame([], STEP), at, -1, baselines)


def follow(stream: DataFrame, root: str, baselines: DataFrame, start: datetime, each: timedelta, state: str, longest: timedelta = timedelta(hours=6)) -> None:
    """Take all amendments that a stream has now; batch n is on record at start + n * each."""
    spark = stream.sparkSession
    run = stream.writeStream.foreachBatch(lambda batch, n: replan(spark, root, baselines, batch, start + n * each, n)).option("checkpointLocation", state).trigger(availableNow=True).start()
    if not run.awaitTermination(longest.total_seconds()):
        run.stop()
        raise TimeoutError("amendments")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All rows on record."""
    return _now(spark, snapshots.batches(spark, root), "versions", VERSION)
