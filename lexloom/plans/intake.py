"""Files, page layout and workflow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_diff
from ..operators import layout, workflow
from ..operators.temporal import as_on
from ..session import shared_folder
from ..sources import files, settings, store
from ..sources import tables as s
from .registry import TASKS, VERSIONS, query


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'application/pdf' WHEN page_id % 5 = 1 THEN NULL ELSE 'text/html' END AS mime,
    'raw/' || substr(sha256(html), 1, 2) || '/' || sha256(html) AS key, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) AS name FROM pages"""
)
def sniffed_pages(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("x "), F.lit("plain"))).otherwise(F.col("html"))
    return s.table(spark, d, "pages").select("page_id", files.mime(F.encode(content, "UTF-8")).alias("mime"), files.raw_key(F.sha2("html", 256)).alias("key"), files.file_name(F.col("url")).alias("name"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN n <> 1 THEN 'given: ' || n END AS problem, CASE WHEN o_orderkey % 7 = 0 THEN 'T' WHEN o_orderkey % 2 = 0 THEN 'doc' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'page' || o_orderkey ELSE 'untitled' END AS title
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM orders)"""
)
def load_requests(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = s.table(spark, d, "orders").select(
        key.alias("k"), F.when(key % 3 == 0, F.concat(F.lit("https://x/y/page"), key.cast("string"), F.lit(".html"))).alias("url"),
        F.when(key % 2 == 0, F.concat(F.lit("a/b/doc"), key.cast("string"), F.lit(".pdf"))).alias("file"), F.lit(None).cast("string").alias("object_key"), F.when(key % 7 == 0, "T").otherwise(" ").alias("title"),
    )
    return files.checked_requests(rows).select("k", "problem", "title")


WORDS = """w AS (SELECT l_orderkey AS page, l_linenumber % 2 AS side, 20.0 + 300 * (l_linenumber % 2) AS x0, 40.0 + (l_linenumber // 2) * 14 AS top, 'w' || l_linenumber AS text FROM lineitem GROUP BY ALL)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of words on each order's page: odd line numbers right, even ones left."""
    lines = s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    x0 = F.lit(20.0) + 300 * (F.col("l_linenumber") % 2)
    top = F.lit(40.0) + F.floor(F.col("l_linenumber") / 2) * 14
    words = lines.select(F.col("l_orderkey").alias("page"), x0.alias("x0"), (x0 + 200).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"))
    return words.withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))


@query(f"WITH {WORDS} SELECT page, 270.0 AS gutter FROM w GROUP BY 1 HAVING count(*) FILTER (side = 0) >= 3 AND count(*) FILTER (side = 1) >= 3")
def page_gutters(spark: SparkSession, d: str) -> DataFrame:
    return layout.gutters(_words(spark, d))


@query(
    f"""WITH {WORDS}, g AS (SELECT page FROM w GROUP BY 1 HAVING count(*) FILTER (side = 0) >= 3 AND count(*) FILTER (side = 1) >= 3), p AS (SELECT w.*, CASE WHEN g.page IS NULL THEN 0 ELSE side END AS col FROM w LEFT JOIN g ON g.page = w.page)
    SELECT page, col AS "column", top, string_agg(text, ' ' ORDER BY x0) AS text FROM p GROUP BY 1, 2, 3"""
)
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines(_words(spark, d)).select("page", "column", "top", "text")


@query(
    f"""WITH {TASKS}, dec AS (SELECT task_id + (CASE WHEN task_id % 50 = 0 THEN 100000000 ELSE 0 END) AS task_id, ['needs_info', 'approve', 'reject', 'edit_approve'][task_id // 10 % 4 + 1] AS action FROM tasks WHERE task_id % 10 = 0)
    SELECT d.task_id, action, CASE WHEN status IN ('done', 'rejected') THEN status WHEN status IS NOT NULL THEN CASE action WHEN 'needs_info' THEN 'in_review' WHEN 'reject' THEN 'rejected' ELSE 'done' END END AS status,
    CASE WHEN status IS NULL THEN 'not_found' WHEN status IN ('done', 'rejected') THEN 'conflict' ELSE 'ok' END AS outcome
    FROM dec d LEFT JOIN tasks t ON t.task_id = d.task_id"""
)
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    tasks = s.tasks(spark, d).select("task_id", "status")
    actions = F.element_at(F.array(*map(F.lit, ("needs_info", "approve", "reject", "edit_approve"))), (F.floor(F.col("task_id") / 10) % 4 + 1).cast("int"))
    asked = tasks.where("task_id % 10 = 0").select((F.col("task_id") + F.when(F.col("task_id") % 50 == 0, 100_000_000).otherwise(0)).alias("task_id"), actions.alias("action"))
    return workflow.decided(tasks, asked, "task_id")


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'pending_review' WHEN c_custkey % 5 = 0 THEN 'reviewed' WHEN c_custkey % 2 = 0 THEN 'auto_published' ELSE 'pending_review' END AS state FROM customer"""
)
def review_states(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    confidence = F.create_map(F.lit("number"), F.lit(0.95), F.when(key % 2 == 0, "date").otherwise("other"), F.lit(0.9))
    least = workflow.least_confidence(confidence, ["number", "date"])
    return s.table(spark, d, "customer").select(key.alias("k"), workflow.review_state(key % 5 == 0, F.when(key % 3 == 0, 1).otherwise(0), least).alias("state"))


@query(
    """WITH h AS (SELECT o_custkey AS query, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
    w AS (SELECT o_custkey AS query, o_orderkey AS doc FROM orders WHERE o_orderstatus = 'F')
    SELECT w.query, round(count(*) FILTER (place <= 3) / count(*), 6) AS recall, round(1 / min(place), 6) AS reciprocal FROM w JOIN h ON h.query = w.query AND h.doc = w.doc GROUP BY 1"""
)
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders")
    hits = orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.row_number().over(workflow.Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))
    return workflow.retrieval_scores(hits, orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc")), 3)


@query(
    f"""WITH {VERSIONS}, a AS (SELECT provision_id, version_id FROM versions WHERE valid_from <= DATE '1996-06-15' AND (valid_to IS NULL OR valid_to > DATE '1996-06-15')),
    b AS (SELECT provision_id, version_id FROM versions WHERE valid_from <= DATE '1999-06-15' AND (valid_to IS NULL OR valid_to > DATE '1999-06-15'))
    SELECT a.provision_id, CASE WHEN a.version_id = b.version_id THEN 'version ' || a.version_id || ' of ' || a.provision_id ELSE 'version [-' || a.version_id || '-]{{+' || b.version_id || '+}} of ' || a.provision_id END AS diff
    FROM a JOIN b ON a.provision_id = b.provision_id"""
)
def diff_of_dates(spark: SparkSession, d: str) -> DataFrame:
    """Provisions that stood on both of two dates, with what changed between them."""
    v = s.versions(spark, d)
    on = lambda day, name: v.where(as_on(F.lit(day).cast("date"))).select("provision_id", F.col("text").alias(name))
    return on("1996-06-15", "a").join(on("1999-06-15", "b"), "provision_id").select("provision_id", word_diff("a", "b").alias("diff"))


@query("SELECT DISTINCT 'raw/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS key, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored by two writers, some of them twice, and read back: each content is there once."""
    root = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    texts = s.table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    store.store(texts.where("doc_id % 3 <> 0").select("content"), root)
    store.store(texts.where("doc_id % 2 = 0 or doc_id % 3 = 0").select("content"), root)
    return store.stored(spark, root, "raw").select("key", "length", F.sha2("content", 256).alias("digest"))


FIELDS = [
    settings.Field("code", "string", pattern="^S", unique=True), settings.Field("name", "string"), settings.Field("kind", "string", choice=("file", "feed", "web")),
    settings.Field("schedule.cadence_hours", "int", least=1), settings.Field("aliases", "array<string>", required=False),
]
ENTRIES = """e AS (SELECT s_suppkey, s_name, s_suppkey // 20 AS file, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) - 1 AS nth, s_suppkey % 8 AS fault, count(*) FILTER (s_suppkey % 8 = 6) OVER () AS same FROM supplier)"""


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Files of twenty suppliers each, as sources of documents; the remainder by eight says which fault an entry has."""
    k, fault = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 8
    hours = F.when(fault == 2, '"six"').when(fault == 3, "0").otherwise((F.col("s_suppkey") % 5 + 1).cast("string"))
    entry = F.concat(
        F.lit('{"code": "S'), F.when(fault == 6, "X").otherwise(k), F.lit('", "name": "'), "s_name", F.lit('", "kind": "'), F.when(fault == 4, "paper").otherwise("web"), F.lit('"'),
        F.when(fault == 1, "").otherwise(F.concat(F.lit(', "schedule": {"cadence_hours": '), hours, F.lit("}"))), F.when(fault == 5, ', "colour": "red"').otherwise(', "aliases": ["a", "b"]'), F.lit("}"),
    )
    rows = s.table(spark, d, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / 20).alias("file"), F.when(fault == 7, '"no entry"').otherwise(entry).alias("entry"))
    docs = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "entry"))).alias("own"))
    folder = f"{shared_folder(spark)}/settings-{uuid.uuid4().hex}"
    text = F.concat(F.lit('{"sources": [\n'), F.array_join(F.transform("own", lambda x: x["entry"]), ",\n"), F.lit("]}"))
    docs.select("file", text.alias("value")).write.partitionBy("file").text(folder)
    return settings.texts(spark, folder)


@query(f"WITH {ENTRIES} SELECT 'S' || CASE WHEN fault = 6 THEN 'X' ELSE CAST(s_suppkey AS VARCHAR) END AS code, s_name AS name, 'web' AS kind, CAST(s_suppkey % 5 + 1 AS INTEGER) AS schedule_cadence_hours, 'a,b' AS aliases FROM e WHERE fault = 0 OR fault = 6 AND same = 1")
def settings_rows(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of the entries that keep all rules."""
    rows, _ = settings.checked(_settings(spark, d), "sources", FIELDS)
    return rows.select("code", "name", "kind", "schedule_cadence_hours", F.array_join("aliases", ",").alias("aliases"))


@query(
    f"""WITH {ENTRIES} SELECT CAST(file AS BIGINT) AS file, 'sources[' || nth || ']' || CASE fault WHEN 4 THEN '.kind' WHEN 5 THEN '.colour' WHEN 6 THEN '.code' WHEN 7 THEN '' ELSE '.schedule.cadence_hours' END AS path,
    CASE fault WHEN 1 THEN 'missing' WHEN 2 THEN 'not a int' WHEN 3 THEN 'below 1' WHEN 4 THEN 'not one of file, feed, web' WHEN 5 THEN 'unknown' WHEN 6 THEN 'repeated' ELSE 'not an object' END AS problem FROM e WHERE fault > 0 AND (fault <> 6 OR same > 1)"""
)
def settings_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that an entry breaks, by file and path."""
    _, violations = settings.checked(_settings(spark, d), "sources", FIELDS)
    return violations.select(F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long").alias("file"), "path", "problem")
