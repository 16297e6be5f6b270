"""Joins and counts behind details: what belongs to a document, a task, a provision or a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, stages
from ..session import shares
from ..sources import tables as s
from .registry import BLOCKS, DOCS, JOBS, TASKS, VERSIONS, query

#: Lines that a task is dealt: they are narrow.
LINES = 1_000_000


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, json_extract_string(props, '$.k')) AS title FROM events""")
def json_titles(spark: SparkSession, d: str) -> DataFrame:
    """A title, or else what stands at a path of a JSON text."""
    return s.table(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.get_json_object("props", "$.k")).alias("title"))


@query(f"WITH {VERSIONS} SELECT c_custkey AS provision_id, n_name AS instrument, version_id, text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY valid_from) AS k FROM versions) v ON v.provision_id = c_custkey AND k = 1")
def baseline_detail(spark: SparkSession, d: str) -> DataFrame:
    """Each provision with its instrument and its baseline, the first version."""
    first = s.versions(spark, d).groupBy("provision_id").agg(F.min_by(F.struct("version_id", "text"), "valid_from").alias("v"))
    joined = s.table(spark, d, "customer").join(s.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(first, F.col("provision_id") == F.col("c_custkey"))
    return joined.select("provision_id", F.col("n_name").alias("instrument"), "v.version_id", "v.text")


@query(
    f"""WITH {TASKS}, {DOCS} SELECT task_id, s_name AS assignee, c_name AS provision, p_name AS amendment, d.source AS document FROM tasks
    LEFT JOIN supplier ON s_suppkey = task_id % 150 LEFT JOIN customer ON kind IN ('amendment', 'treatment') AND c_custkey = subject_id LEFT JOIN part ON kind = 'amendment' AND p_partkey = subject_id LEFT JOIN docs d ON kind IN ('metadata', 'parse_failure') AND d.doc_id = subject_id"""
)
def task_details(spark: SparkSession, d: str) -> DataFrame:
    """Tasks with who has them and, by their kind, the provision, amendment or document they are about."""
    kind, subject = F.col("kind"), F.col("subject_id")
    rows = s.tasks(spark, d).join(s.table(spark, d, "supplier"), F.col("s_suppkey") == F.col("task_id") % 150, "left")
    rows = rows.join(s.table(spark, d, "customer"), kind.isin("amendment", "treatment") & (F.col("c_custkey") == subject), "left")
    rows = rows.join(s.table(spark, d, "part"), (kind == "amendment") & (F.col("p_partkey") == subject), "left")
    rows = rows.join(s.documents(spark, d).select("doc_id", F.col("source").alias("document")), kind.isin("metadata", "parse_failure") & (F.col("doc_id") == subject), "left")
    return rows.select("task_id", F.col("s_name").alias("assignee"), F.col("c_name").alias("provision"), F.col("p_name").alias("amendment"), "document")


@query("SELECT l_partkey AS doc_id, s_name AS source, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2")
def document_sources(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    tasks = shares(lines, LINES)
    seen = lines.repartition(tasks, "l_partkey").groupBy(F.col("l_partkey").alias("doc_id"), "l_suppkey").agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    named = seen.repartition(tasks, "l_suppkey").join(s.table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("source")), F.col("s_suppkey") == F.col("l_suppkey"))
    return named.repartition(tasks, "doc_id").groupBy("doc_id", "source").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query(f"WITH {BLOCKS} SELECT doc_id, seq FROM blocks WHERE doc_id IN (SELECT doc_id FROM docs WHERE status = 'stayed') AND seq % 2 = 0")
def owned_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks asked for that belong to the documents asked about."""
    owners = s.documents(spark, d).where("status = 'stayed'").select("doc_id")
    return s.blocks(spark, d).where("seq % 2 = 0").join(owners, "doc_id", "left_semi").select("doc_id", "seq")


@query(
    f"""WITH {VERSIONS}, {DOCS}, a AS (SELECT provision_id, version_id, valid_from AS effective_from, version_id % 300 AS doc_id FROM versions)
    SELECT provision_id, version_id, row_number() OVER (PARTITION BY provision_id ORDER BY effective_from, doc_date NULLS LAST, a.doc_id, version_id) AS place FROM a JOIN docs d ON d.doc_id = a.doc_id"""
)
def replay_order(spark: SparkSession, d: str) -> DataFrame:
    """Amendments in the order they are replayed: by their day, their document's day, the document and themselves."""
    from ..operators.law import Window

    a = s.versions(spark, d).select("provision_id", "version_id", F.col("valid_from").alias("effective_from"), (F.col("version_id") % 300).alias("doc_id"))
    order = Window.partitionBy("provision_id").orderBy("effective_from", F.asc_nulls_last("doc_date"), "doc_id", "version_id")
    return a.join(s.documents(spark, d).select("doc_id", "doc_date"), "doc_id").select("provision_id", "version_id", F.row_number().over(order).alias("place"))


@query(f"WITH {VERSIONS} SELECT version_id, n_name AS instrument, c_mktsegment AS level FROM versions JOIN customer ON c_custkey = provision_id JOIN nation ON n_nationkey = c_nationkey WHERE rec_to IS NULL AND c_nationkey % 2 = 0")
def provision_scan(spark: SparkSession, d: str) -> DataFrame:
    """The versions on record of some instruments, as they are indexed."""
    rows = s.versions(spark, d).where("rec_to is null").join(s.table(spark, d, "customer").where("c_nationkey % 2 = 0"), F.col("c_custkey") == F.col("provision_id"))
    return rows.join(s.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("version_id", F.col("n_name").alias("instrument"), F.col("c_mktsegment").alias("level"))


@query(f"WITH {TASKS} SELECT subject_id, kind, count(*) AS tasks, count(*) FILTER (status IN ('open', 'in_review')) AS open_tasks FROM tasks GROUP BY 1, 2")
def tasks_by_subject(spark: SparkSession, d: str) -> DataFrame:
    """What there is already for a subject, so that nothing is made twice."""
    opened = F.count(F.when(F.col("status").isin("open", "in_review"), 1))
    return s.tasks(spark, d).groupBy("subject_id", "kind").agg(F.count("*").alias("tasks"), opened.alias("open_tasks"))


@query(f"WITH {JOBS} SELECT event_id, source, status FROM jobs WHERE event_id = 42")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    return s.jobs(spark, d).where("event_id = 42").select("event_id", "source", "status")


@query(
    """WITH k AS (SELECT o_custkey, max(o_orderdate) AS known FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1), f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
    SELECT f.o_custkey AS provision_id, CASE WHEN first > known THEN 'append' ELSE 'replay' END AS action FROM f LEFT JOIN k USING (o_custkey)"""
)
def late_replans(spark: SparkSession, d: str) -> DataFrame:
    """What late amendments (every fifth) ask of their provisions: an addition, or a replay where one is of an earlier day."""
    orders = s.table(spark, d, "orders").select(F.col("o_custkey").alias("provision_id"), F.col("o_orderdate").alias("effective_from"), (F.col("o_orderkey") % 5 == 0).alias("late"))
    return stages.replanned(orders.where(~F.col("late")), orders.where("late"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Documents (orders) with one number or two."""
    key = F.col("o_orderkey")
    return s.table(spark, d, "orders").select("o_custkey", key.alias("doc"), dedup.numbers_of(F.concat(F.lit("n"), (key % 3).cast("string")), F.when(key % 4 != 0, F.concat(F.lit("m"), (key % 4).cast("string"))), F.lit(" ")).alias("numbers"))


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND (a.o_orderkey % 3 = b.o_orderkey % 3 OR a.o_orderkey % 4 = b.o_orderkey % 4 AND a.o_orderkey % 4 <> 0)")
def shared_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one day and court whose numbers have one in common, whichever of their numbers it is."""
    return dedup.sharing_pairs(_numbered(spark, d), "o_custkey", "doc", "numbers")


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey AS doc, 'n' || (o_orderkey % 3) AS number FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'm' || (o_orderkey % 4) FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT o_custkey, number, doc, target FROM (SELECT *, min(doc) OVER w AS target, count(*) OVER w AS n FROM n WINDOW w AS (PARTITION BY o_custkey, number)) WHERE n > 1"""
)
def shared_number_targets(spark: SparkSession, d: str) -> DataFrame:
    """The same documents by number, under the least of them."""
    return dedup.sharing(_numbered(spark, d), "o_custkey", "doc", "numbers")
