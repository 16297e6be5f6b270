"""Users, roles, tenants and what may be edited."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as a
from ..operators import relations as r
from ..sources import tables as s
from .registry import TASKS, query

ROLES = """roles AS (SELECT c_custkey AS user_id, unnest(list_filter(['admin', 'editor', 'reader'], lambda x: (x = 'admin' AND c_custkey % 7 = 0) OR (x = 'editor' AND c_custkey % 3 = 0) OR (x = 'reader' AND c_custkey % 2 = 0))) AS role FROM customer)"""


def _users(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as users; every seventh an admin, every third an editor, every second a reader."""
    c = s.table(spark, d, "customer")
    key = F.col("c_custkey")
    roles = F.array_compact(F.array(F.when(key % 7 == 0, "admin"), F.when(key % 3 == 0, "editor"), F.when(key % 2 == 0, "reader")))
    return c.select(key.alias("user_id"), F.col("c_name").alias("name")), c.select(key.alias("user_id"), F.explode(roles).alias("role"))


@query(f"WITH {ROLES} SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM roles WHERE user_id = c_custkey AND role IN ('admin', 'editor'))")
def editors(spark: SparkSession, d: str) -> DataFrame:
    users, roles = _users(spark, d)
    return a.with_roles(users, roles, ["admin", "editor"])


@query(f"WITH {ROLES} SELECT c_custkey AS user_id, coalesce((SELECT string_agg(role, ',' ORDER BY role) FROM roles WHERE user_id = c_custkey), '') AS roles FROM customer")
def users_with_roles(spark: SparkSession, d: str) -> DataFrame:
    users, roles = _users(spark, d)
    return a.role_lists(users, roles).select("user_id", F.array_join("roles", ",").alias("roles"))


@query(f"WITH {ROLES} SELECT c_custkey AS user_id, c_custkey IN (SELECT user_id FROM roles WHERE role IN ('admin', 'editor')) AS allowed FROM customer")
def may_decide(spark: SparkSession, d: str) -> DataFrame:
    users, roles = _users(spark, d)
    return a.allowed(users, roles, "review.decide").select("user_id", "allowed")


@query("SELECT user_id, name, roles, total FROM (SELECT c_custkey AS user_id, c_name AS name, (SELECT count(*) FROM customer) AS total, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS roles FROM customer) WHERE user_id > 40 ORDER BY user_id LIMIT 21")
def keyset_users(spark: SparkSession, d: str) -> DataFrame:
    """A page of users by id with their roles and the number of all users; roles are looked up for the page alone."""
    users, roles = _users(spark, d)
    page = r.page_after(users, {"user_id": 40}, 20)
    total = users.select(F.count("*")).scalar()
    return a.role_lists(page, roles).select("user_id", "name", F.size("roles").alias("roles"), total.alias("total"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 4 = 0 OR o_custkey % 4 = 2 AND o_custkey % 3 = 1")
def tenant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tenant 1, and those without a tenant."""
    tenant = F.when(F.col("o_custkey") % 4 == 0, None).when(F.col("o_custkey") % 4 == 2, F.col("o_custkey") % 3).otherwise(-1)
    return s.table(spark, d, "orders").where(a.of_tenant(tenant, F.lit(1))).select(F.col("o_orderkey").alias("id"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'colour,size' WHEN p_partkey % 3 = 1 THEN '' ELSE 'size' END AS unknown FROM part")
def unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    fields = F.when(F.col("p_partkey") % 3 == 0, F.create_map(*map(F.lit, ("title", "t", "size", "1", "colour", "red")))).when(F.col("p_partkey") % 3 == 1, F.create_map(*map(F.lit, ("title", "t")))).otherwise(F.create_map(*map(F.lit, ("size", "1", "series", "CT"))))
    return a.unknown_fields(s.table(spark, d, "part").select("p_partkey", fields.alias("fields"))).select("p_partkey", F.array_join("unknown", ",").alias("unknown"))


@query(f"""WITH {TASKS} SELECT task_id, CASE kind WHEN 'parse_failure' THEN 1 WHEN 'amendment' THEN 2 WHEN 'miss_report' THEN 3 WHEN 'metadata' THEN 4 ELSE 5 END AS priority, base64(encode('["' || task_id || '","' || kind || '"]')) AS cursor FROM tasks""")
def task_priorities(spark: SparkSession, d: str) -> DataFrame:
    """The order tasks are looked at in, and the mark of each as the last of a page."""
    return s.tasks(spark, d).select("task_id", a.priority(F.col("kind")).alias("priority"), a.cursor(F.col("task_id"), F.col("kind")).alias("cursor"))


MARK = base64.b64encode(b'["1","1998-01-01 00:00:00","100"]').decode()
OPEN = f"WITH {TASKS}, f AS (SELECT priority, CAST(opened_at AS TIMESTAMP) AS opened_at, task_id, kind FROM tasks WHERE status = 'open' AND kind <> 'metadata')"


@query(
    f"""{OPEN}, p AS (SELECT *, row_number() OVER (ORDER BY priority, opened_at, task_id) AS nth FROM f WHERE (priority, opened_at, task_id) > (1, TIMESTAMP '1998-01-01', 100))
    SELECT priority, opened_at, task_id, kind, (SELECT count(*) FROM f) AS total, CASE WHEN (SELECT count(*) FROM p) > 25 THEN (SELECT base64(encode('["' || priority || '","' || strftime(opened_at, '%Y-%m-%d %H:%M:%S') || '","' || task_id || '"]')) FROM p WHERE nth = 25) END AS next FROM p WHERE nth <= 25"""
)
def task_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the review list: filters, a mark to go on from, the exact total and the mark of the next page in one query."""
    kinds = F.col("kind") != "metadata"
    found = s.tasks(spark, d).where(r.all_of(F.col("status") == "open", kinds, None)).select("priority", F.col("opened_at").cast("timestamp").alias("opened_at"), "task_id", "kind")
    return a.page(found, ["priority", "opened_at", "task_id"], 25, MARK)


@query(
    """WITH f AS (SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'click') AND user_id % 3 = 1 AND ts >= (SELECT min(ts) FROM events) AND ts < (SELECT max(ts) FROM events) AND value >= 1 AND value < 90 AND event_id % 2 = 0),
    p AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS nth FROM f)
    SELECT event_id, event_type, user_id, (SELECT count(*) FROM f) AS total, CASE WHEN (SELECT count(*) FROM p) > 40 THEN (SELECT base64(encode('["' || event_id || '"]')) FROM p WHERE nth = 40) END AS next FROM p WHERE nth <= 40"""
)
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the audit list, latest first, with all seven filters set."""
    events = s.table(spark, d, "events")
    span = events.select(F.min("ts").alias("begin"), F.max("ts").alias("end"))
    begin, end = span.select("begin").scalar(), span.select("end").scalar()
    found = events.where(r.all_of(F.col("event_type").isin("error", "click"), F.col("user_id") % 3 == 1, F.col("ts") >= begin, F.col("ts") < end, F.col("value") >= 1, F.col("value") < 90, F.col("event_id") % 2 == 0))
    return a.page(found.select("event_id", "event_type", "user_id"), ["event_id"], 40, descending=True)
