"""Pages, trees, counts, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as r
from ..operators import temporal as t
from ..sources import tables as s
from .registry import DOCS, LINKS, TASKS, VERSIONS, query


@query(
    """SELECT n_nationkey AS instrument_id, n_name AS name, count(DISTINCT c_custkey) AS provisions, count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END) AS with_text,
    count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) AS verified FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def baseline_counts(spark: SparkSession, d: str) -> DataFrame:
    # orders meet customers first as one row a customer, so the fan-out never leaves the shuffle on o_custkey
    orders = s.table(spark, d, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    joined = s.table(spark, d, "nation").join(s.table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.col("n_nationkey").alias("instrument_id"), F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("provisions"), F.count("o_custkey").alias("with_text"), F.count(F.when(F.col("done") == 1, 1)).alias("verified"))


@query(f"WITH {VERSIONS} SELECT c_custkey AS provision_id, c_name AS label, version_id FROM customer LEFT JOIN versions ON provision_id = c_custkey AND rec_to IS NULL AND valid_from <= DATE '1996-01-01' AND (valid_to IS NULL OR valid_to > DATE '1996-01-01')")
def baseline_provisions(spark: SparkSession, d: str) -> DataFrame:
    valid = s.versions(spark, d).where(t.current() & t.as_on(F.lit("1996-01-01").cast("date")))
    return s.table(spark, d, "customer").join(valid, F.col("provision_id") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("provision_id"), F.col("c_name").alias("label"), "version_id")


NUMBERS = "numbers AS (SELECT o_custkey AS provision_id, o_orderkey AS seq, o_orderkey % 23 AS number FROM orders)"


def numbers(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "orders").select(F.col("o_custkey").alias("provision_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 23).alias("number"))


#: Missing numbers one by one, and runs of them: a run's numbers less their places in order are all the same.
HOLES = f"""{NUMBERS}, b AS (SELECT provision_id, min(number) AS first, max(number) AS last, list(DISTINCT number) AS have FROM numbers GROUP BY 1),
missing AS (SELECT provision_id, x FROM (SELECT provision_id, have, unnest(range(first, last + 1)) AS x FROM b) WHERE NOT list_contains(have, x)),
holes AS (SELECT provision_id, min(x) AS number, max(x) AS upto FROM (SELECT *, x - row_number() OVER (PARTITION BY provision_id ORDER BY x) AS run FROM missing) GROUP BY provision_id, run)"""


@query(
    f"""WITH {HOLES}, g AS (SELECT provision_id, CAST(sum(upto - number + 1) AS BIGINT) AS n, string_agg(CASE WHEN upto > number THEN number || '-' || upto ELSE CAST(number AS VARCHAR) END, ',' ORDER BY number) AS gaps FROM holes GROUP BY 1)
    SELECT provision_id, first, last, coalesce(n, 0) AS n_gaps, coalesce(gaps, '') AS gaps FROM b LEFT JOIN g USING (provision_id)"""
)
def numbering_gaps(spark: SparkSession, d: str) -> DataFrame:
    return r.numbering_gaps(numbers(spark, d), "provision_id", "number")


@query(
    f"""WITH {NUMBERS}, b AS (SELECT provision_id, min(number) AS first, max(number) AS last, list(DISTINCT number) AS have FROM numbers GROUP BY 1)
    SELECT provision_id, 'duplicate' AS problem, number FROM numbers GROUP BY 1, 3 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT provision_id, 'out_of_order', number FROM (SELECT *, lag(number) OVER (PARTITION BY provision_id ORDER BY seq) AS before FROM numbers) WHERE number < before
    UNION ALL SELECT provision_id, 'gap', x FROM (SELECT provision_id, have, unnest(range(first, last + 1)) AS x FROM b) WHERE NOT list_contains(have, x)"""
)
def numbering_gate(spark: SparkSession, d: str) -> DataFrame:
    return r.each_number(r.numbering_problems(numbers(spark, d), "provision_id", "seq", "number"))


@query(
    f"""WITH {HOLES} SELECT provision_id, 'duplicate' AS problem, number, number AS upto FROM numbers GROUP BY 1, 3 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT provision_id, 'out_of_order', number, number FROM (SELECT *, lag(number) OVER (PARTITION BY provision_id ORDER BY seq) AS before FROM numbers) WHERE number < before
    UNION ALL SELECT provision_id, 'gap', number, upto FROM holes"""
)
def numbering_gate_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The same problems, missing numbers as ranges."""
    return r.numbering_problems(numbers(spark, d), "provision_id", "seq", "number")


@query(
    """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_regionkey AS ordinal FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier),
    tree AS (SELECT id, parent_id, 0 AS depth, lpad(CAST(ordinal AS VARCHAR), 10, '0') AS sort_key FROM nodes WHERE parent_id IS NULL
    UNION ALL SELECT n.id, n.parent_id, depth + 1, sort_key || '.' || lpad(CAST(ordinal AS VARCHAR), 10, '0') FROM nodes n JOIN tree t ON n.parent_id = t.id) SELECT * FROM tree"""
)
def tree_order(spark: SparkSession, d: str) -> DataFrame:
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    nodes = s.table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("ordinal"))
    nodes = nodes.unionByName(s.table(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("ordinal")))
    nodes = nodes.unionByName(s.table(spark, d, "supplier").select(key("s", "s_suppkey").alias("id"), key("n", "s_nationkey").alias("parent_id"), F.col("s_suppkey").alias("ordinal")))
    return r.tree_order(nodes)


@query(f"WITH {DOCS} SELECT doc_id, doc_type, source FROM docs WHERE doc_id < 800 AND status = 'in_force' AND source ILIKE '%src%' ORDER BY doc_id DESC LIMIT 51")
def keyset_documents(spark: SparkSession, d: str) -> DataFrame:
    found = s.documents(spark, d).where(r.all_of(F.col("status") == "in_force", r.contains("source", "src"))).select("doc_id", "doc_type", "source")
    return r.page_after(found, {"doc_id": 800}, 50, descending=True)


@query(f"WITH {TASKS} SELECT priority, opened_at, task_id, kind FROM tasks WHERE status = 'open' AND (priority, opened_at, task_id) > (1, TIMESTAMP '1998-01-01', 100) ORDER BY 1, 2, 3 LIMIT 51")
def keyset_tasks(spark: SparkSession, d: str) -> DataFrame:
    found = s.tasks(spark, d).where("status = 'open'").select("priority", "opened_at", "task_id", "kind")
    return r.page_after(found, {"priority": 1, "opened_at": "1998-01-01 00:00:00", "task_id": 100}, 50)


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id < 5000 AND event_type = 'error' AND user_id % 2 = 0 ORDER BY event_id DESC LIMIT 51")
def keyset_audit(spark: SparkSession, d: str) -> DataFrame:
    found = s.table(spark, d, "events").where("event_type = 'error' AND user_id % 2 = 0").select("event_id", "event_type", "user_id")
    return r.page_after(found, {"event_id": 5000}, 50, descending=True)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%part%1%' OR p_brand LIKE 'Brand#1_'")
def like_filter(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "part").where(F.col("p_name").ilike("%part%1%") | F.col("p_brand").like("Brand#1_")).select("p_partkey", "p_name", "p_brand")


@query(r"SELECT n, n ILIKE '%a\_b%' ESCAPE '\' AS hit FROM (VALUES ('a_b'), ('axb'), ('50%'), ('A_B c'), ('a\b')) t(n)")
def like_escape(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("a_b",), ("axb",), ("50%",), ("A_B c",), ("a\\b",)], "n string")
    return rows.select("n", r.contains("n", "a_b").alias("hit"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def source_exists(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").join(s.table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE n_chars > 5000 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exists_or(spark: SparkSession, d: str) -> DataFrame:
    toxic = s.table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return s.table(spark, d, "documents").join(toxic, "doc_id", "left").where((F.col("n_chars") > 5000) | F.col("hit")).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").join(s.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query(
    f"""WITH {TASKS} SELECT task_id, kind, CASE WHEN kind = 'amendment' THEN c_name WHEN kind = 'metadata' THEN s_name END AS subject FROM tasks
    LEFT JOIN customer ON kind = 'amendment' AND c_custkey = subject_id LEFT JOIN supplier ON kind = 'metadata' AND s_suppkey = subject_id"""
)
def subject_case_join(spark: SparkSession, d: str) -> DataFrame:
    tasks = s.tasks(spark, d)
    joined = tasks.join(s.table(spark, d, "customer"), (F.col("kind") == "amendment") & (F.col("c_custkey") == F.col("subject_id")), "left")
    joined = joined.join(s.table(spark, d, "supplier"), (F.col("kind") == "metadata") & (F.col("s_suppkey") == F.col("subject_id")), "left")
    return joined.select("task_id", "kind", F.when(F.col("kind") == "amendment", F.col("c_name")).when(F.col("kind") == "metadata", F.col("s_name")).alias("subject"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) WHERE place <= 20")
def top_blocks_per_page(spark: SparkSession, d: str) -> DataFrame:
    return r.top_per_group(s.table(spark, d, "events"), "user_id", 20, F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "place")


@query(
    """WITH a AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1)
    SELECT coalesce(b.k, a.k) AS k, coalesce(b.n, a.n) AS n, CASE WHEN a.k IS NULL THEN 'stored' WHEN b.k IS NULL THEN 'given' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.k = b.k"""
)
def full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    given = s.table(spark, d, "supplier").where("s_suppkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    stored = s.table(spark, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return r.merged_config(given, stored, "k", ["n"])


@query(
    f"""WITH {DOCS}, {LINKS}, b AS (SELECT dst_id, src_id, CASE WHEN link_type IN ('inserts', 'substitutes', 'omits', 'amends') THEN 'amending_instruments' WHEN link_type = 'mentions' THEN 'mentions'
    WHEN link_type = 'issued_under' THEN 'issued_under' WHEN link_type = 'clarifies' THEN 'circulars' WHEN link_type = 'interprets' THEN 'judgements' WHEN doc_type IN ('circular', 'instruction') THEN 'circulars'
    WHEN doc_type = 'judgement' THEN 'judgements' ELSE 'other' END AS bucket
    FROM links JOIN docs ON doc_id = src_id WHERE dst_type = 'provision') SELECT dst_id, bucket, count(*) AS links, count(DISTINCT src_id) AS documents FROM b GROUP BY 1, 2"""
)
def links_grouped(spark: SparkSession, d: str) -> DataFrame:
    return r.linked(s.links(spark, d), s.documents(spark, d).select("doc_id", "doc_type"))


PATHS = "paths AS (SELECT doc_id, 'ch' || doc_id % 9 || '.s' || doc_id % 50 AS path FROM documents), asked AS (SELECT doc_id AS ask, 's' || doc_id % 70 AS path FROM documents WHERE doc_id % 10 = 0)"


@query(f"WITH {PATHS} SELECT ask, doc_id, place FROM (SELECT ask, p.doc_id, row_number() OVER (PARTITION BY ask ORDER BY p.doc_id) AS place FROM asked a JOIN paths p ON regexp_matches(p.path, '^(ch[0-9]+\\.)?' || a.path || '$')) WHERE place <= 5")
def path_match(spark: SparkSession, d: str) -> DataFrame:
    """Paths with or without their chapter: canonical paths make it an equi-join, of the first documents of each path alone, since all who ask for it get the same."""
    docs = s.table(spark, d, "documents")
    paths = docs.select("doc_id", r.without_chapter(F.concat(F.lit("ch"), F.col("doc_id") % 9, F.lit(".s"), F.col("doc_id") % 50)).alias("path"))
    asked = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("ask"), F.concat(F.lit("s"), F.col("doc_id") % 70).alias("path"))
    return r.first_of_path(asked, paths, "path", "doc_id", 5).select("ask", "doc_id", "place")


@query(
    """WITH hits AS (SELECT c_custkey, c_nationkey, count(s_suppkey) OVER (PARTITION BY c_custkey) AS n, s_suppkey FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 17 = 0)
    SELECT c_custkey AS proposal, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN s_suppkey END AS target FROM hits GROUP BY 1, 2, 3"""
)
def target_resolution(spark: SparkSession, d: str) -> DataFrame:
    targets = s.table(spark, d, "supplier").where("s_suppkey % 17 = 0").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("one"))
    joined = s.table(spark, d, "customer").join(targets, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(F.col("c_custkey").alias("proposal"), F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous").alias("outcome"), F.when(n == 1, F.col("one")).alias("target"))


@query("WITH ranked AS (SELECT s_suppkey AS editor, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, count(*) OVER () AS total FROM supplier) SELECT o_orderkey AS task_id, editor FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 8 = 0) JOIN ranked ON n = k % total")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.writes import round_robin as deal

    tasks = s.table(spark, d, "orders").where("o_orderstatus = 'O' AND o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("task_id"))
    return deal(tasks, "task_id", s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("editor")), "editor")
