"""Snapshots, histories, chains and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import writes as w
from ..sources import tables as s
from .registry import query

SCD = """draft AS (SELECT o_custkey AS k, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1),
live AS (SELECT o_custkey AS k, md5(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest, max(o_orderkey) % 3 = 0 AS amended FROM orders WHERE o_orderkey % 25 <> 1 AND o_custkey % 4 <> 1 GROUP BY 1)"""


def _digests(orders: DataFrame) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(F.md5(F.array_join(keys, ",")).alias("digest"), (F.max("o_orderkey") % 3 == 0).alias("amended"))


@query(
    f"""WITH {SCD} SELECT coalesce(d.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'create' WHEN d.k IS NULL THEN 'orphan' WHEN d.digest = l.digest THEN 'unchanged' WHEN amended THEN 'skip' ELSE 'replace' END AS action,
    d.digest AS new_digest, l.digest AS old_digest FROM draft d FULL JOIN live l ON d.k = l.k"""
)
def scd_baseline(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders")
    return w.baseline_actions(_digests(orders.where("o_orderkey % 5 <> 0")).drop("amended"), _digests(orders.where("o_orderkey % 25 <> 1 AND o_custkey % 4 <> 1")), "k", "digest", "amended")


@query(
    f"""WITH {SCD}, act AS (SELECT coalesce(d.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'create' WHEN d.k IS NULL THEN 'orphan' WHEN d.digest = l.digest THEN 'unchanged' WHEN amended THEN 'skip' ELSE 'replace' END AS action,
    d.digest AS n, l.digest AS o FROM draft d FULL JOIN live l ON d.k = l.k)
    SELECT k, o AS digest, DATE '2020-01-01' AS rec_from, CASE WHEN action = 'replace' THEN DATE '2024-01-01' END AS rec_to FROM act WHERE o IS NOT NULL
    UNION ALL SELECT k, n, DATE '2024-01-01', NULL FROM act WHERE action IN ('create', 'replace')"""
)
def scd_snapshot(spark: SparkSession, d: str) -> DataFrame:
    orders = s.table(spark, d, "orders")
    draft = _digests(orders.where("o_orderkey % 5 <> 0")).drop("amended")
    live = _digests(orders.where("o_orderkey % 25 <> 1 AND o_custkey % 4 <> 1")).withColumn("rec_from", F.lit("2020-01-01").cast("date")).withColumn("rec_to", F.lit(None).cast("date"))
    actions = w.baseline_actions(draft, live, "k", "digest", "amended")
    return w.snapshot(draft, live.drop("amended"), actions, "k", F.lit("2024-01-01").cast("date")).select("k", "digest", "rec_from", "rec_to")


@query(
    """WITH c AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS valid_from, max(o_orderstatus) AS status FROM orders GROUP BY 1, 2),
    kept AS (SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY k ORDER BY valid_from) AS before FROM c) WHERE before IS NULL OR before <> status)
    SELECT k, status, valid_from, lead(valid_from) OVER (PARTITION BY k ORDER BY valid_from) AS valid_to FROM kept"""
)
def status_history(spark: SparkSession, d: str) -> DataFrame:
    changes = s.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("valid_from")).agg(F.max("o_orderstatus").alias("status"))
    return w.status_history(changes, "k").select("k", "status", "valid_from", "valid_to")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    stored = s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return w.upsert(stored, s.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k")


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_linenumber = 1)")
def link_insert(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    return w.insert_absent(lines.where("l_linenumber = 1").select("src", "dst"), lines.select("src", "dst"), "src", "dst")


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS title, c_name AS name,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS place FROM customer"""
)
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    c = s.table(spark, d, "customer")
    entry = lambda key, value: F.create_map(F.lit(key), value)
    none = F.create_map().cast("map<string,string>")
    old = F.create_map(F.lit("title"), F.col("c_name"), F.lit("name"), F.col("c_name"))
    proposal = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("title"), F.col("c_mktsegment"), F.lit("place"), F.col("c_nationkey").cast("string"))).otherwise(none)
    explicit = F.when(F.col("c_custkey") % 3 == 0, entry("title", F.concat(F.lit("x"), F.col("c_custkey").cast("string")))).otherwise(none)
    got = c.select(F.col("c_custkey").alias("k"), w.merged_metadata(old, proposal, explicit).alias("m"))
    return got.select("k", F.col("m")["title"].alias("title"), F.col("m")["name"].alias("name"), F.try_element_at("m", F.lit("place")).alias("place"))


CHAIN = """p AS (SELECT event_id, user_id, concat_ws('|', event_id, event_type, user_id) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
chain AS (SELECT user_id, event_id, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS row_hash FROM p WHERE n = 1
UNION ALL SELECT p.user_id, p.event_id, p.n, c.row_hash, sha256(c.row_hash || p.payload) FROM chain c JOIN p ON p.user_id = c.user_id AND p.n = c.n + 1)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "events").select("event_id", "user_id", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).alias("payload"))


@query(f"WITH RECURSIVE {CHAIN} SELECT user_id, event_id, prev_hash, row_hash FROM chain")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return w.chained(_log(spark, d), "user_id", "event_id", "payload")


@query("SELECT event_id, event_id % 97 <> 0 AS ok FROM events")
def audit_verify(spark: SparkSession, d: str) -> DataFrame:
    """True chains, in which every 97th payload was changed afterwards."""
    log = _log(spark, d)
    chain = w.chained(log, "user_id", "event_id", "payload")
    forged = log.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return w.verified(chain.join(forged, ["user_id", "event_id"]), "user_id", "event_id", "payload").select("event_id", "ok")


@query("SELECT o_orderkey AS k FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || 'audit'), 1 LIMIT (SELECT CAST(greatest(1, round_even(count(*) * 2.5 / 100, 0)) AS BIGINT) FROM orders)")
def sample_audit(spark: SparkSession, d: str) -> DataFrame:
    return w.sampled(s.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", 2.5, "audit")
