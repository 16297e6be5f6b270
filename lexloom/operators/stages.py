"""Stages that documents go through: what is due, what comes next, what a publication sets, and who takes which job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workflow import review_state

#: The stages in order; a notification's text goes to detection beside its publication.
CHAIN = ("acquire", "parse", "classify", "segment", "extract_meta", "apply_metadata", "publish")
BESIDE = {"apply_metadata": ("notification", "amend_detect"), "publish": (None, "index")}


def due(versions: DataFrame, done: DataFrame, stage: str, version: str) -> DataFrame:
    """Versions (version_id) that a stage has not treated with this version of itself; the rest are skipped."""
    same = done.where((F.col("stage") == stage) & (F.col("stage_version") == version)).select("version_id")
    return versions.join(same, "version_id", "left_anti")


def queued_next(treated: DataFrame) -> DataFrame:
    """(version_id, stage): the stages that follow those treated (version_id, stage, doc_type), whether they did work or were skipped."""
    after = F.create_map(*[F.lit(x) for pair in zip(CHAIN, CHAIN[1:], strict=False) for x in pair])
    both = [F.try_element_at(after, F.col("stage"))]
    for stage, (doc_type, extra) in BESIDE.items():
        fits = F.col("stage") == stage
        both.append(F.when(fits & (F.col("doc_type") == doc_type) if doc_type else fits, extra))
    return treated.select("version_id", F.explode(F.array_compact(F.array(*both))).alias("stage"))


def claimable(queue: DataFrame, now: Column) -> DataFrame:
    """The job each queue hands out next: of those that are due the one made first."""
    order = Window.partitionBy("queue").orderBy("created_at", "event_id")
    return queue.where((F.col("status") == "queued") & (F.col("run_after") <= now)).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def published(documents: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """documents (doc_id, reviewed, meta_confidence) with their review state by the open tasks (doc_id, status) on them, published now."""
    opened = tasks.where(F.col("status").isin("open", "in_review")).groupBy("doc_id").agg(F.count("*").alias("open_tasks"))
    rows = documents.join(opened, "doc_id", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0)))
    return rows.select("doc_id", "open_tasks", review_state(F.col("reviewed"), F.col("open_tasks"), F.col("meta_confidence")).alias("review_state"), now.alias("published_at"))


def replanned(amendments: DataFrame, late: DataFrame) -> DataFrame:
    """(provision_id, action) of amendments (provision_id, effective_from) that came late.

    A provision whose late amendments all follow those known has them appended; one of an earlier or the same day, or a
    provision without known ones, has its whole timeline replayed.
    """
    known = amendments.groupBy("provision_id").agg(F.max("effective_from").alias("known"))
    first = late.groupBy("provision_id").agg(F.min("effective_from").alias("first"))
    action = F.when(F.col("first") > F.col("known"), "append").otherwise("replay")
    return first.join(known, "provision_id", "left").select("provision_id", action.alias("action"))
