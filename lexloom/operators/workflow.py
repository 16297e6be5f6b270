"""State changes of tasks and jobs by tables of allowed transitions, and scores of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an action makes of a status, by kind of thing; anything else is a conflict.
OPEN = ("open", "in_review")
TRANSITIONS = {
    "review": [(status, action, after) for status in OPEN for action, after in (("approve", "done"), ("edit_approve", "done"), ("reject", "rejected"), ("needs_info", "in_review"))],
    "job": [("failed", "retry", "queued")],
    "baseline": [("loaded", "verify", "verified")],
}
#: The confidence from which a document without open tasks is published by itself.
SURE = 0.85


def decided(things: DataFrame, decisions: DataFrame, key: str, kind: str = "review") -> DataFrame:
    """things (key, status) after decisions (key, action): the new status, and ok, conflict or not_found."""
    table = decisions.sparkSession.createDataFrame(TRANSITIONS[kind], "status string, action string, next string")
    joined = decisions.join(things, key, "left").join(F.broadcast(table), ["status", "action"], "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("next").isNull(), "conflict").otherwise("ok")
    return joined.select(key, "action", F.coalesce("next", "status").alias("status"), outcome.alias("outcome"))


def review_state(reviewed, open_tasks, confidence):
    """pending_review while tasks are open; then reviewed, or auto_published where the confidence is SURE or more."""
    return F.when(open_tasks > 0, "pending_review").when(reviewed, "reviewed").when(F.coalesce(confidence >= SURE, F.lit(False)), "auto_published").otherwise("pending_review")


def least_confidence(confidence, required: list[str]):
    """The least confidence of the required fields; a missing one counts 0."""
    return F.array_min(F.array(*[F.coalesce(F.try_element_at(confidence, F.lit(f)), F.lit(0.0)) for f in required]))


def retrieval_scores(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Of hits (query, doc, place) and wanted (query, doc): recall within the first k and the reciprocal first place."""
    found = wanted.join(hits, ["query", "doc"], "left")
    by_query = found.groupBy("query").agg((F.count(F.when(F.col("place") <= k, 1)) / F.count("*")).alias("recall"), F.coalesce(1 / F.min("place"), F.lit(0.0)).alias("reciprocal"))
    return by_query.select("query", F.round("recall", 6).alias("recall"), F.round("reciprocal", 6).alias("reciprocal"))


def latest_two(versions: DataFrame, key: str) -> DataFrame:
    """Each key's last version text beside the one before."""
    order = Window.partitionBy(key).orderBy(F.desc("valid_from"))
    ranked = versions.withColumn("n", F.row_number().over(order)).withColumn("before", F.lead("text").over(order))
    return ranked.where("n = 1").select(key, "before", F.col("text").alias("after"))
