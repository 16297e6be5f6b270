"""Metric views over ingestion jobs, pages, tasks and queues, and the alert rules on them.

`now` is always a column or literal given by the caller, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alert thresholds.
FAILURE_RATE, FRESHNESS_HOURS, STALE_FACTOR, LAG_MINUTES = 0.05, 12.0, 3, 30.0


def hours(later: Column, earlier: Column) -> Column:
    """Hours between two moments, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ingest_daily(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Jobs of the last days by source and day: all, and by status."""
    recent = jobs.where(F.col("discovered_at") >= now - F.make_dt_interval(F.lit(days)))
    states = ("done", "failed", "queued", "running", "skipped")
    return recent.groupBy("source", F.to_date("discovered_at").alias("day")).agg(F.count("*").alias("discovered"), *[count_where(F.col("status") == s).alias(s) for s in states])


def freshness(jobs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Hours from discovery to publication of what was discovered in the last days: median and 95th percentile by source and over all (is_total)."""
    done = jobs.where(F.col("published_at").isNotNull() & (F.col("discovered_at") >= now - F.make_dt_interval(F.lit(days)))).withColumn("h", hours(F.col("published_at"), F.col("discovered_at")))
    both = [F.round(F.percentile("h", F.lit(p)), 6).alias(n) for p, n in ((0.5, "p50_hours"), (0.95, "p95_hours"))]
    by_source = done.groupBy("source").agg(*both, F.count("*").alias("published")).withColumn("is_total", F.lit(False))
    total = done.agg(*both, F.count("*").alias("published")).select(F.lit(None).cast("long").alias("source"), "p50_hours", "p95_hours", "published", F.lit(True).alias("is_total"))
    return by_source.unionByName(total)


def source_health(sources: DataFrame, now: Column) -> DataFrame:
    """Hours since each source's last new document, and whether that is beyond three times its cadence."""
    since = hours(now, F.col("last_new_doc_at"))
    stale = F.coalesce(since > F.lit(STALE_FACTOR) * F.col("cadence_hours"), F.lit(False))
    return sources.select("source", "cadence_hours", F.round(since, 6).alias("hours_since"), stale.alias("stale"))


def review_queue(tasks: DataFrame, now: Column) -> DataFrame:
    """Open work by kind and status, with the oldest opening and what is overdue."""
    overdue = F.col("sla_due_at").isNotNull() & (F.col("sla_due_at") < now)
    return tasks.where(F.col("status").isin("open", "in_review")).groupBy("kind", "status").agg(F.count("*").alias("tasks"), F.min("opened_at").alias("oldest"), count_where(overdue).alias("overdue"))


def page_accounting(pages: DataFrame, versions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Pages by method and status: all, flagged, and of versions (doc_id, parsed_at) parsed in the last days."""
    recent = F.col("parsed_at") >= now - F.make_dt_interval(F.lit(days))
    return pages.join(versions, "doc_id").groupBy("method", "status").agg(F.count("*").alias("pages"), count_where(F.col("flagged")).alias("flagged"), count_where(recent).alias("pages_last_30d"))


def mismatch(a: Column, b: Column, margin: float) -> Column:
    """Whether two engines' character counts differ by more than a share of the larger."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1)) > margin


def cross_check(pages: DataFrame, margin: float = 0.05) -> DataFrame:
    """Pages that both engines read, and those on which they differ by more than a share of the larger count."""
    both = pages.where("chars_a is not null and chars_b is not null")
    return both.agg(F.count("*").alias("pages"), count_where(F.abs(F.col("chars_a") - F.col("chars_b")) > margin * F.greatest("chars_a", "chars_b")).alias("disagree"))


def queue_lag(queue: DataFrame, now: Column) -> DataFrame:
    waiting = queue.where("status = 'queued'").groupBy("queue").agg(F.count("*").alias("queued"), F.min("run_after").alias("oldest"), F.min("created_at").alias("oldest_created"))
    return waiting.withColumn("lag_minutes", F.round(F.greatest(F.lit(0.0), hours(now, F.col("oldest")) * 60), 4))


def failure_rate(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs of the last 24 hours: all, failed and their ratio (0 when there are none)."""
    day = jobs.where(F.col("discovered_at") >= now - F.expr("interval 24 hours"))
    out = day.agg(F.count("*").alias("total"), count_where(F.col("status") == "failed").alias("failed"))
    return out.withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("failed") / F.col("total")).otherwise(0.0), 6))


def alerts(jobs: DataFrame, sources: DataFrame, tasks: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """A row (rule, subject, value) for each rule that is broken."""
    row = lambda df, rule, subject, value: df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.round(value.cast("double"), 4).alias("value"))
    none = F.lit("all")
    parts = [
        row(failure_rate(jobs, now).where(F.col("rate") > FAILURE_RATE), "failure_rate", none, F.col("rate")),
        row(freshness(jobs, now).where(F.col("is_total") & (F.col("p95_hours") > FRESHNESS_HOURS)), "freshness", none, F.col("p95_hours")),
        row(source_health(sources, now).where("stale"), "stale_source", F.col("source"), F.col("hours_since")),
        row(review_queue(tasks, now).groupBy().agg(F.sum("overdue").alias("n")).where("n > 0"), "overdue_reviews", none, F.col("n")),
        row(queue_lag(queue, now).where(F.col("lag_minutes") > LAG_MINUTES), "queue_lag", F.col("queue"), F.col("lag_minutes")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def open_by_kind(tasks: DataFrame, now: Column) -> DataFrame:
    return review_queue(tasks, now).groupBy("kind").agg(F.sum("tasks").alias("open_tasks"), F.min("oldest").alias("oldest"))


def totals(tasks: DataFrame, pages: DataFrame, jobs: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """One row of dashboard totals, each from its own view."""
    overdue = review_queue(tasks, now).agg(F.sum("overdue").alias("overdue_tasks"))
    flagged = pages.agg(count_where(F.col("flagged")).alias("flagged_pages"))
    failed = ingest_daily(jobs, now).agg(F.sum("failed").alias("failed_jobs"))
    lag = queue_lag(queue, now).agg(F.max("lag_minutes").alias("max_lag_minutes"))
    one = F.lit(1).alias("one")  # four single rows meet on a constant
    return overdue.withColumn("one", one).join(flagged.withColumn("one", one), "one").join(failed.withColumn("one", one), "one").join(lag.withColumn("one", one), "one").drop("one")
