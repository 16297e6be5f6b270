"""Metric views, alerts and dashboard totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources import tables as s
from .registry import JOBS, PAGES, QUEUE, SOURCES, TASKS, query

HOURS = "(epoch_us({}) - epoch_us({})) / 3.6e9"


def _now(spark: SparkSession, d: str):
    return s.now_of(s.table(spark, d, "events"), "ts")


def _later(spark: SparkSession, d: str):
    return s.now_of(s.table(spark, d, "orders"), "o_orderdate")


DAILY = """SELECT source, CAST(discovered_at AS DATE) AS day, count(*) AS discovered, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'skipped') AS skipped
FROM jobs, moment WHERE discovered_at >= now_at - INTERVAL 30 DAY GROUP BY 1, 2"""


@query(f"WITH {JOBS} {DAILY}")
def ingest_daily(spark: SparkSession, d: str) -> DataFrame:
    return m.ingest_daily(s.jobs(spark, d), _now(spark, d))


FRESH = f"""done AS (SELECT source, {HOURS.format("published_at", "discovered_at")} AS h FROM jobs, moment WHERE published_at IS NOT NULL AND discovered_at >= now_at - INTERVAL 7 DAY),
fresh AS (SELECT source, round(quantile_cont(h, 0.5), 6) AS p50_hours, round(quantile_cont(h, 0.95), 6) AS p95_hours, count(*) AS published, false AS is_total FROM done GROUP BY 1
UNION ALL SELECT NULL, round(quantile_cont(h, 0.5), 6), round(quantile_cont(h, 0.95), 6), count(*), true FROM done)"""


@query(f"WITH {JOBS}, {FRESH} SELECT * FROM fresh")
def ingest_freshness(spark: SparkSession, d: str) -> DataFrame:
    return m.freshness(s.jobs(spark, d), _now(spark, d))


HEALTH = f"health AS (SELECT source, cadence_hours, round({HOURS.format('now_at', 'last_new_doc_at')}, 6) AS hours_since, coalesce({HOURS.format('now_at', 'last_new_doc_at')} > 3 * cadence_hours, false) AS stale FROM sources, moment)"


@query(f"WITH {JOBS}, {SOURCES}, {HEALTH} SELECT * FROM health")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return m.source_health(s.sources(spark, d), _now(spark, d))


REVIEW = "review AS (SELECT kind, status, count(*) AS tasks, min(opened_at) AS oldest, count(*) FILTER (sla_due_at < now_at) AS overdue FROM tasks, later WHERE status IN ('open', 'in_review') GROUP BY 1, 2)"


@query(f"WITH {TASKS}, {REVIEW} SELECT * FROM review")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return m.review_queue(s.tasks(spark, d), _later(spark, d))


@query(
    f"""WITH {PAGES} SELECT method, p.status, count(*) AS pages, count(*) FILTER (flagged) AS flagged, count(*) FILTER (doc_date >= (SELECT max(doc_date) FROM docs) - 30) AS pages_last_30d
    FROM pages_ p JOIN docs USING (doc_id) GROUP BY 1, 2"""
)
def page_accounting(spark: SparkSession, d: str) -> DataFrame:
    parsed = s.documents(spark, d).select("doc_id", F.col("doc_date").alias("parsed_at"))
    return m.page_accounting(s.pages(spark, d), parsed, s.now_of(parsed, "parsed_at"))


@query(f"WITH {PAGES} SELECT count(*) AS pages, count(*) FILTER (abs(chars_a - chars_b) > 0.05 * greatest(chars_a, chars_b)) AS disagree FROM pages_ WHERE doc_id % 13 <> 0")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every 13th document one engine gave nothing."""
    pages = s.pages(spark, d)
    return m.cross_check(pages.withColumn("chars_b", F.when(F.col("doc_id") % 13 != 0, F.col("chars_b"))))


LAG = f"lag_ AS (SELECT queue, count(*) AS queued, min(run_after) AS oldest, min(created_at) AS oldest_created, round(greatest(0, 60 * {HOURS.format('max(now_at)', 'min(run_after)')}), 4) AS lag_minutes FROM queue, moment GROUP BY 1)"


@query(f"WITH {JOBS}, {QUEUE}, {LAG} SELECT * FROM lag_")
def queue_lag(spark: SparkSession, d: str) -> DataFrame:
    return m.queue_lag(s.queue(spark, d), _now(spark, d))


RATE = """rate_ AS (SELECT total, failed, round(CASE WHEN total > 0 THEN failed / total ELSE 0.0 END, 6) AS rate FROM
(SELECT count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM jobs, moment WHERE discovered_at >= now_at - INTERVAL 24 HOUR))"""


@query(f"WITH {JOBS}, {RATE} SELECT * FROM rate_")
def failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return m.failure_rate(s.jobs(spark, d), _now(spark, d))


@query(
    f"""WITH {JOBS}, {SOURCES}, {QUEUE}, {TASKS}, {FRESH}, {HEALTH}, {LAG}, {RATE}
    SELECT 'failure_rate' AS rule, 'all' AS subject, round(rate, 4) AS value FROM rate_ WHERE rate > 0.05
    UNION ALL SELECT 'freshness', 'all', round(p95_hours, 4) FROM fresh WHERE is_total AND p95_hours > 12
    UNION ALL SELECT 'stale_source', CAST(source AS VARCHAR), round(hours_since, 4) FROM health WHERE stale
    UNION ALL SELECT 'overdue_reviews', 'all', CAST(n AS DOUBLE) FROM (SELECT count(*) AS n FROM tasks, moment WHERE sla_due_at < now_at AND status IN ('open', 'in_review')) WHERE n > 0
    UNION ALL SELECT 'queue_lag', CAST(queue AS VARCHAR), lag_minutes FROM lag_ WHERE lag_minutes > 30"""
)
def alerts(spark: SparkSession, d: str) -> DataFrame:
    return m.alerts(s.jobs(spark, d), s.sources(spark, d), s.tasks(spark, d), s.queue(spark, d), _now(spark, d))


@query(f"WITH {TASKS} SELECT kind, CAST(count(*) AS BIGINT) AS open_tasks, min(opened_at) AS oldest FROM tasks WHERE status IN ('open', 'in_review') GROUP BY 1")
def open_tasks_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return m.open_by_kind(s.tasks(spark, d), _later(spark, d))


@query(
    f"""WITH {JOBS}, {QUEUE}, {TASKS}, {PAGES}, {LAG}
    SELECT (SELECT count(*) FROM tasks, moment WHERE sla_due_at < now_at AND status IN ('open', 'in_review')) AS overdue_tasks, (SELECT count(*) FROM pages_ WHERE flagged) AS flagged_pages,
    (SELECT count(*) FROM jobs, moment WHERE status = 'failed' AND discovered_at >= now_at - INTERVAL 30 DAY) AS failed_jobs, (SELECT max(lag_minutes) FROM lag_) AS max_lag_minutes"""
)
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    return m.totals(s.tasks(spark, d), s.pages(spark, d), s.jobs(spark, d), s.queue(spark, d), _now(spark, d))
