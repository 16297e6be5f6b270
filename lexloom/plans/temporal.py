"""Queries on bitemporal versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal as t
from ..sources import tables
from .registry import VERSIONS, query

DAY = "1998-06-15"


@query(f"WITH {VERSIONS} SELECT provision_id, version_id, valid_from, valid_to FROM versions WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}')")
def point_in_time(spark: SparkSession, d: str) -> DataFrame:
    return tables.versions(spark, d).where(t.as_on(F.lit(DAY).cast("date"))).select("provision_id", "version_id", "valid_from", "valid_to")


@query(f"WITH {VERSIONS} SELECT provision_id, version_id, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY valid_from DESC) AS n FROM versions) WHERE n = 1")
def version_latest(spark: SparkSession, d: str) -> DataFrame:
    return t.latest(tables.versions(spark, d), "provision_id", F.desc("valid_from")).select("provision_id", "version_id", "valid_from")


@query(
    f"""WITH {VERSIONS} SELECT provision_id, valid_from, valid_to, row_number() OVER (PARTITION BY provision_id ORDER BY valid_from) AS version_no,
    length(text) AS text_length, substr(text, 1, 200) AS summary, c_name AS amended_by, n_name AS place
    FROM versions LEFT JOIN customer ON c_custkey = provision_id AND version_id % 2 = 0 LEFT JOIN nation ON n_nationkey = c_nationkey"""
)
def version_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.versions(spark, d).withColumn("version_no", F.row_number().over(Window.partitionBy("provision_id").orderBy("valid_from")))
    customer, nation = tables.table(spark, d, "customer"), tables.table(spark, d, "nation")
    joined = rows.join(customer, (F.col("c_custkey") == F.col("provision_id")) & (F.col("version_id") % 2 == 0), "left").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("provision_id", "valid_from", "valid_to", "version_no", F.length("text").alias("text_length"), F.substring("text", 1, 200).alias("summary"), F.col("c_name").alias("amended_by"), F.col("n_name").alias("place"))


@query(
    f"""WITH {VERSIONS}, w AS (SELECT provision_id, version_id, valid_from, CASE WHEN version_id % 7 = 0 THEN valid_to + 40 ELSE valid_to END AS valid_to FROM versions)
    SELECT DISTINCT b.provision_id, b.version_id, b.valid_from FROM w a JOIN w b ON a.provision_id = b.provision_id AND a.valid_from < b.valid_from
    AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)"""
)
def version_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    wrong = tables.versions(spark, d).withColumn("valid_to", F.when(F.col("version_id") % 7 == 0, F.date_add("valid_to", 40)).otherwise(F.col("valid_to")))
    return t.overlaps(wrong, "provision_id").select("provision_id", "version_id", "valid_from")


@query(f"WITH {VERSIONS} SELECT provision_id, version_id, valid_from, valid_to FROM versions WHERE valid_from <= DATE '1997-06-30' AND (valid_to IS NULL OR valid_to > DATE '1997-01-01')")
def period_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.versions(spark, d)
    return rows.where(t.overlapping(F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date"))).select("provision_id", "version_id", "valid_from", "valid_to")


@query(
    f"""WITH {VERSIONS} SELECT provision_id, version_id, valid_from FROM versions WHERE rec_from <= DATE '1998-07-01' AND (rec_to IS NULL OR rec_to > DATE '1998-07-01')
    AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}')"""
)
def audit_replay(spark: SparkSession, d: str) -> DataFrame:
    seen = t.recorded(F.lit("1998-07-01").cast("date")) & t.as_on(F.lit(DAY).cast("date"))
    return tables.versions(spark, d).where(seen).select("provision_id", "version_id", "valid_from")


PROBES = "probes AS (SELECT event_id, user_id AS provision_id, DATE '1995-01-01' + CAST(event_id % 2400 AS INTEGER) AS on_date FROM events)"


def probes(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("event_id", F.col("user_id").alias("provision_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 2400).cast("int")).alias("on_date"))


@query(
    f"""WITH {VERSIONS}, {PROBES} SELECT event_id, p.provision_id, on_date, v.valid_from, v.version_id FROM probes p
    ASOF LEFT JOIN versions v ON p.provision_id = v.provision_id AND p.on_date >= v.valid_from"""
)
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    return t.as_of_join(probes(spark, d), tables.versions(spark, d), "provision_id", "on_date", "valid_from", ["version_id"]).select("event_id", "provision_id", "on_date", "valid_from", "version_id")


@query(
    f"""WITH {VERSIONS}, {PROBES}, newest AS (SELECT provision_id, arg_max(version_id, valid_from) AS newest FROM versions WHERE version_id % 3 <> 0 GROUP BY 1)
    SELECT event_id, p.provision_id, on_date, CASE WHEN v.version_id IS NOT NULL THEN v.version_id ELSE newest END AS version_id,
    CASE WHEN v.version_id IS NOT NULL THEN 'valid' WHEN newest IS NOT NULL THEN 'latest' ELSE 'none' END AS found
    FROM probes p LEFT JOIN versions v ON v.version_id % 3 <> 0 AND v.provision_id = p.provision_id AND v.valid_from <= on_date AND (v.valid_to IS NULL OR v.valid_to > on_date)
    LEFT JOIN newest n ON n.provision_id = p.provision_id"""
)
def asof_or_latest(spark: SparkSession, d: str) -> DataFrame:
    return t.valid_or_latest(probes(spark, d), tables.versions(spark, d).where("version_id % 3 <> 0"), "provision_id", "on_date", "version_id")
