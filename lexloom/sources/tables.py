"""Tables as Parquet folders, and the relations that the sample tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Document types and their authority ranks, by doc_id modulo 6.
TYPES = (("act", 2), ("rules", 4), ("notification", 5), ("circular", 8), ("order", 8), ("judgement", 6))
STATUSES = ("in_force", "amended", "superseded", "rescinded", "struck_down", "stayed", "in_force")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index, values) -> object:
    """The value at an index column."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provision versions: one for each customer and order day, valid until the next; every 11th closed on record."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(F.col("o_custkey").alias("provision_id"), F.to_date("o_orderdate").alias("valid_from")).agg(F.min("o_orderkey").alias("version_id"))
    out = rows.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("provision_id").orderBy("valid_from")))
    closed = F.when(F.col("version_id") % 11 == 0, F.date_add("valid_from", 30))
    return out.withColumn("rec_from", F.col("valid_from")).withColumn("rec_to", closed).withColumn("text", F.concat(F.lit("version "), F.col("version_id").cast("string"), F.lit(" of "), F.col("provision_id").cast("string")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = (F.col("doc_id") % 6).cast("int")
    return docs.select(
        "doc_id", "text", "source",
        pick(kind, [t for t, _ in TYPES]).alias("doc_type"),
        pick(kind, [r for _, r in TYPES]).alias("authority_rank"),
        F.date_add(F.lit("2017-07-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).alias("doc_date"),
        pick((F.col("doc_id") % 7).cast("int"), STATUSES).alias("status"),
    )


def lines(docs: DataFrame) -> DataFrame:
    """A document's columns for each of its lines that is not blank; text is the line, seq its number from 0."""
    return docs.select(*(c for c in docs.columns if c != "text"), F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("seq", "text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are not blank, numbered from 0."""
    rows = lines(documents(spark, sf_dir)).select("doc_id", "doc_type", "seq", "text")
    return rows.withColumn("path", F.when(F.col("seq") == 0, "pre").otherwise(F.concat(F.lit("p"), F.col("seq"))))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion jobs: events by kind; those done are published some minutes after their discovery."""
    events = table(spark, sf_dir, "events")
    state = F.create_map(*[F.lit(x) for kv in (("click", "done"), ("error", "failed"), ("purchase", "skipped"), ("signup", "queued")) for x in kv])
    status = state[F.col("event_type")]
    later = F.col("ts") + F.make_dt_interval(mins=(F.floor(F.col("value")) % 3000).cast("int"))
    return events.select("event_id", (F.col("user_id") % 7).alias("source"), status.alias("status"), F.col("ts").alias("discovered_at"), F.when(status == "done", later).alias("published_at"))


def now_of(df: DataFrame, column: str):
    """The latest moment of a column, as a subquery of the plan it is used in: the reports' `now`."""
    return df.select(F.max(column)).scalar()


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return events.select("event_id", (F.col("user_id") % 5).alias("queue"), F.lit("queued").alias("status"), F.col("ts").alias("run_after"), (F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 3).cast("int"))).alias("created_at"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job sources with a cadence in hours; a source's last document comes from its even event ids."""
    j = jobs(spark, sf_dir)
    return j.groupBy("source").agg(F.max(F.when((F.col("event_id") % 97 == F.col("source")) & (F.col("source") != 6), F.col("discovered_at"))).alias("last_new_doc_at")).withColumn("cadence_hours", F.col("source") % 3 + 1)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review tasks from orders: kind by priority, status by order status, due eight hours after opening."""
    orders = table(spark, sf_dir, "orders")
    kinds = F.create_map(*[F.lit(x) for kv in (("1", "amendment"), ("2", "metadata"), ("3", "parse_failure"), ("4", "miss_report"), ("5", "treatment")) for x in kv])
    states = F.create_map(*[F.lit(x) for kv in (("O", "open"), ("P", "in_review"), ("F", "done")) for x in kv])
    return orders.select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("subject_id"),
        F.coalesce(kinds[F.substring("o_orderpriority", 1, 1)], F.lit("metadata")).alias("kind"),
        F.coalesce(states[F.col("o_orderstatus")], F.lit("rejected")).alias("status"),
        F.col("o_orderdate").alias("opened_at"), (F.col("o_orderdate") + F.expr("interval 8 hours")).alias("sla_due_at"),
        (F.col("o_orderkey") % 5).alias("priority"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page extractions: one for each block."""
    rows = blocks(spark, sf_dir).select("doc_id", F.col("seq").alias("page_no"), F.length("text").alias("chars_a"), F.greatest(F.length("text") - (F.col("doc_id") % 20).cast("int"), F.lit(0)).alias("chars_b"))
    method = F.when(F.col("chars_a") < 20, "failed").when(F.col("doc_id") % 5 == 0, "ocr").otherwise("text")
    return rows.withColumn("method", method).withColumn("status", F.when(method == "failed", "failed").otherwise("ok")).withColumn("flagged", F.abs(F.col("chars_a") - F.col("chars_b")) > 10)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    kinds = F.create_map(*[F.lit(x) for kv in (("AF", "amends"), ("NF", "interprets"), ("RF", "clarifies")) for x in kv])
    number = F.col("l_linenumber") % 3
    others = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.when(number == 0, "mentions").when(number == 1, "cites").otherwise("issued_under")).otherwise("substitutes")
    return lines.select(F.lit("document").alias("src_type"), F.col("l_partkey").alias("src_id"), F.when(F.col("l_linenumber") % 7 == 0, "document").otherwise("provision").alias("dst_type"), F.col("l_suppkey").alias("dst_id"), F.coalesce(kinds[F.concat("l_returnflag", "l_linestatus")], others).alias("link_type"))
