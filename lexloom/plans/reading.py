"""Pages read, flagged and accounted for; stages, queues and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as p
from ..operators import stages as st
from ..operators import writes as w
from ..operators.chunking import indexed
from ..sources import tables as s
from .registry import BLOCKS, JOBS, QUEUE, TASKS, query

READ = """r AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_partkey END AS chars_a, CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN l_partkey * 2 ELSE l_partkey END AS chars_b,
l_discount * 2 AS garble, CASE WHEN l_suppkey % 3 = 0 THEN l_tax * 10 END AS ocr_conf, CASE WHEN l_partkey % 13 = 0 THEN repeat('e', 600) END AS error FROM lineitem)"""


def _read(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as pages of documents: some without text, some read twice with other results, garbled, from images or with an error."""
    key = F.col("l_partkey")
    none = key % 11 == 0
    return s.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.when(none, 0).otherwise(key).alias("chars_a"), F.when(none, 0).when(key % 5 == 0, key * 2).otherwise(key).alias("chars_b"),
        (F.col("l_discount") * 2).alias("garble"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_tax") * 10).alias("ocr_conf"), F.when(key % 13 == 0, F.repeat(F.lit("e"), 600)).alias("error"),
    )


DECIDED = f"""{READ}, dec AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN chars_a = 0 THEN 'no_text' WHEN ocr_conf < 0.6 THEN 'low_ocr_confidence' WHEN garble > 0.15 THEN 'garbled' WHEN ocr_conf IS NULL AND chars_a <> chars_b THEN 'cross_check_mismatch' END AS reason FROM r),
pages_ AS (SELECT doc_id, page_no, ocr_conf, CASE WHEN reason IN ('error', 'no_text') THEN 'failed' WHEN ocr_conf IS NOT NULL THEN 'ocr' ELSE 'text' END AS method, CASE WHEN reason IN ('error', 'no_text') THEN 'failed' WHEN reason IS NOT NULL THEN 'flagged' ELSE 'ok' END AS status, reason, length(left(error, 500)) AS error_length FROM dec)"""


@query(f"WITH {DECIDED} SELECT doc_id, page_no, method, status, reason, error_length FROM pages_")
def page_decisions(spark: SparkSession, d: str) -> DataFrame:
    return p.decided(_read(spark, d)).select("doc_id", "page_no", "method", "status", "reason", F.length("error_text").alias("error_length"))


@query("SELECT l_orderkey AS doc_id, count(*) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS page_count, count(*) AS n, l_orderkey % 10 <> 0 AND count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS whole FROM lineitem GROUP BY l_orderkey")
def page_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth version says it has a page more than was read."""
    pages = _read(spark, d)
    versions = pages.groupBy("doc_id").agg((F.count("*") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("page_count"))
    return p.accounted(pages, versions, "doc_id")


@query(
    f"""WITH {DECIDED}, {BLOCKS}, own AS (SELECT doc_id, seq // 40 + 1 AS page_no, seq, text, row_number() OVER (PARTITION BY doc_id, seq // 40 ORDER BY seq) AS place FROM blocks),
    g AS (SELECT doc_id, page_no, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS block_seqs, substr(string_agg(text, chr(10) ORDER BY seq), 1, 5000) AS page_text FROM own WHERE place <= 20 GROUP BY 1, 2)
    SELECT p.doc_id, p.page_no, method, status, reason, coalesce(block_seqs, '') AS block_seqs, sha256(page_text) AS page_text FROM pages_ p LEFT JOIN g ON g.doc_id = p.doc_id AND g.page_no = p.page_no WHERE status <> 'ok'"""
)
def problem_pages(spark: SparkSession, d: str) -> DataFrame:
    blocks = s.blocks(spark, d).select("doc_id", (F.floor(F.col("seq") / 40) + 1).cast("int").alias("page_no"), "seq", "text")
    got = p.problems(p.decided(_read(spark, d)), blocks, "doc_id")
    return got.select("doc_id", "page_no", "method", "status", "reason", F.array_join("block_seqs", ",").alias("block_seqs"), F.sha2("page_text", 256).alias("page_text"))


@query(f"WITH {DECIDED} SELECT doc_id, round(avg(ocr_conf), 6) AS ocr_conf FROM pages_ WHERE method = 'ocr' GROUP BY 1")
def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    return p.ocr_confidence(p.decided(_read(spark, d)), "doc_id")


@query(
    """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS conf, 'w' || l_partkey AS word FROM lineitem WHERE l_partkey % 7 <> 0)
    , l AS (SELECT doc_id, n % 2 AS par, n // 2 % 2 AS line, string_agg(word, ' ' ORDER BY n, word) AS text, min(n) AS first, sum(conf) AS conf, count(*) AS k FROM w GROUP BY 1, 2, 3)
    , q AS (SELECT doc_id, par, string_agg(text, ' ' ORDER BY first) AS text, min(first) AS first, sum(conf) AS conf, sum(k) AS k FROM l GROUP BY 1, 2)
    SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY first) AS text, round(sum(conf) / sum(k) / 100, 6) AS ocr_conf FROM q GROUP BY 1"""
)
def ocr_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """A reader's lines: words with a confidence, others without, and rows of other levels."""
    n = F.col("l_linenumber")
    cells = lambda level, conf: F.concat_ws("\t", F.lit(level), F.lit("1"), F.lit("1"), (n % 2).cast("string"), (F.floor(n / 2) % 2).cast("string"), n.cast("string"), *[F.lit("0")] * 4, conf, F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    good = F.when(F.col("l_partkey") % 7 == 0, "-1").otherwise(F.col("l_quantity").cast("int").cast("string"))
    both = F.array(cells("5", good), cells("4", F.lit("-1")))
    return p.ocr_words(s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("at"), F.explode(both).alias("line")), "doc_id")


@query(r"SELECT doc_id, generate_subscripts(parts, 1) - 1 AS seq, unnest(parts) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '') AS parts FROM documents)")
def blank_line_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return p.paragraphs_of(s.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n \n")).alias("text")), "doc_id")


@query("SELECT l_orderkey AS page, l_linenumber AS n FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber BETWEEN 2 AND 4)")
def outside_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every third page has a table from its second to its fourth line; every page's box elsewhere holds nothing."""
    words = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.lit(10.0).alias("x0"), F.lit(30.0).alias("x1"), (F.col("l_linenumber") * 10.0).alias("top"), (F.col("l_linenumber") * 10.0 + 8).alias("bottom"))
    box = lambda rows, top, bottom: rows.select("page", F.lit(0.0).alias("x0"), F.lit(top).alias("top"), F.lit(100.0).alias("x1"), F.lit(bottom).alias("bottom"))
    pages = words.select("page").distinct()
    return p.outside_tables(words, box(pages.where("page % 3 = 0"), 20.0, 48.0).unionByName(box(pages, 900.0, 950.0))).select("page", "n")


@query("SELECT p_partkey, p_size / 600.0 < 0.05 AS thin, round(least(100, greatest(0, p_size * 4.0 - 10)), 4) AS left_percent, round(CASE WHEN p_size % 5 = 0 THEN NULL ELSE least(100, greatest(0, p_size % 5 * 20.0)) END, 4) AS width_percent FROM part")
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page has too few characters for its size, and boxes in percent of it, cut at its edges; null without an area."""
    size = F.col("p_size").cast("double")
    x0 = size * 4 - 10
    part = p.percent_box({"x0": x0, "x1": x0 + (F.col("p_size") % 5) * 20, "top": F.lit(1.0), "bottom": F.lit(2.0)}, F.lit(100.0), F.lit(50.0))
    fixed = p.percent_box({"x0": x0, "x1": x0 + 1, "top": F.lit(1.0), "bottom": F.lit(2.0)}, F.lit(100.0), F.lit(50.0))
    return s.table(spark, d, "part").select("p_partkey", p.needs_ocr(size, F.lit(20.0), F.lit(30.0), 0.05).alias("thin"), F.round(fixed["left"], 4).alias("left_percent"), F.round(part["width"], 4).alias("width_percent"))


@query("SELECT l_suppkey AS provision_id, min(l_linenumber) AS page FROM lineitem GROUP BY 1")
def first_pages(spark: SparkSession, d: str) -> DataFrame:
    lines = s.table(spark, d, "lineitem").withColumn("block_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    owned = lines.groupBy(F.col("l_suppkey").alias("provision_id")).agg(F.collect_set("block_id").alias("block_ids"))
    return p.first_page(lines.select("block_id", F.col("l_linenumber").alias("page")), owned, "provision_id")


@query("SELECT o_orderkey AS version_id FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0)")
def stage_due(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth version was parsed before, every third of them by an older parser."""
    orders = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"))
    done = orders.where("version_id % 4 = 0").withColumn("stage", F.lit("parse")).withColumn("stage_version", F.when(F.col("version_id") % 3 == 0, "parse-1").otherwise("parse-2"))
    return st.due(orders, done, "parse", "parse-2")


@query(
    """SELECT o_orderkey AS version_id, unnest(CASE o_orderkey % 7 WHEN 0 THEN ['parse'] WHEN 1 THEN ['classify'] WHEN 2 THEN ['segment'] WHEN 3 THEN ['extract_meta'] WHEN 4 THEN ['apply_metadata'] WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN ['publish', 'amend_detect'] ELSE ['publish'] END ELSE ['index'] END) AS stage FROM orders"""
)
def stage_chain(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, st.CHAIN)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return st.queued_next(s.table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), stage.alias("stage"), F.when(F.col("o_custkey") % 2 == 0, "notification").otherwise("act").alias("doc_type")))


@query(f"WITH {JOBS}, {QUEUE} SELECT queue, event_id FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY created_at, event_id) AS n FROM queue WHERE run_after <= TIMESTAMP '2024-01-20') WHERE n = 1")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return st.claimable(s.queue(spark, d), F.lit("2024-01-20").cast("timestamp_ntz")).select("queue", "event_id")


@query(
    f"""WITH {TASKS}, o AS (SELECT subject_id AS doc_id, count(*) AS open_tasks FROM tasks WHERE status IN ('open', 'in_review') GROUP BY 1)
    SELECT c_custkey AS doc_id, coalesce(open_tasks, 0) AS open_tasks, CASE WHEN open_tasks > 0 THEN 'pending_review' WHEN c_custkey % 2 = 0 THEN 'reviewed' WHEN c_custkey % 3 = 0 THEN 'auto_published' ELSE 'pending_review' END AS review_state FROM customer LEFT JOIN o ON doc_id = c_custkey"""
)
def publish(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    docs = s.table(spark, d, "customer").select(key.alias("doc_id"), (key % 2 == 0).alias("reviewed"), F.when(key % 3 == 0, 0.9).when(key % 5 == 0, 0.5).alias("meta_confidence"))
    tasks = s.tasks(spark, d).select(F.col("subject_id").alias("doc_id"), "status")
    return st.published(docs, tasks, F.lit("2024-01-01").cast("timestamp_ntz")).select("doc_id", "open_tasks", "review_state")


@query("SELECT c_custkey AS k, 'in_force' AS status, coalesce(CASE WHEN c_custkey % 2 = 0 THEN DATE '2020-02-01' END, DATE '2020-01-01') AS valid_from FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def first_status(spark: SparkSession, d: str) -> DataFrame:
    """Customers without orders have no status row yet."""
    docs = s.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2020-02-01").cast("date")).alias("in_force_date"), F.lit("2020-01-01").cast("date").alias("doc_date"))
    return w.first_status(s.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), docs, "k")


@query("SELECT o_orderkey AS k, 'in_force' AS status, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 30 ELSE CAST(o_orderdate AS DATE) END AS valid_from FROM orders WHERE o_orderstatus = 'O'")
def first_status_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are open have no status row yet; the others keep theirs."""
    orders = s.table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    docs = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 2 == 0, F.date_add(day, 30)).alias("in_force_date"), day.alias("doc_date"))
    return w.first_status(orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k")), docs, "k")


@query("SELECT l_orderkey AS k, l_linenumber AS part, l_partkey AS v FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, 0, count(*) FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1")
def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """What every third order had is replaced by one row."""
    lines = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("part"), F.col("l_partkey").alias("v"))
    return w.replaced(lines, lines.where("k % 3 = 0").groupBy("k").agg(F.lit(0).alias("part"), F.count("*").alias("v")), "k")


@query("SELECT 'id' || o_custkey AS canonical_id, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 HAVING count(*) > 1")
def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    ids = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("id"), F.col("o_custkey").cast("string")))
    return w.collisions(s.table(spark, d, "orders").select("o_orderkey", ids.alias("canonical_id")), "o_orderkey", "canonical_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS corpus_version FROM events WHERE event_type = 'purchase'")
def corpus_versions(spark: SparkSession, d: str) -> DataFrame:
    """Changes counted in order; each change has a moment of its own."""
    events = s.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.timestamp_micros(F.col("event_id")).alias("at"))
    return w.corpus_versions(events, "at").select("event_id", "corpus_version")


@query(
    f"""WITH {BLOCKS} SELECT doc_id, seq, 2 AS batch, doc_id % 5 <> 0 OR seq < 1 AS is_current, DATE '2017-07-01' + CAST(doc_id % 1000 AS INTEGER) AS valid_from FROM blocks WHERE doc_id % 5 = 0 AND seq < 1
    UNION ALL SELECT doc_id, seq, 1, doc_id % 5 <> 0, DATE '2017-07-01' + CAST(doc_id % 1000 AS INTEGER) FROM blocks"""
)
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """A second batch with the first block of every fifth document, after a first one with all."""
    docs = s.documents(spark, d).withColumn("in_force_date", F.lit(None).cast("date"))
    blocks = s.blocks(spark, d).select("doc_id", "seq", "text")
    kinds = "doc_id long, seq int, text string, doc_type string, authority_rank int, status string, valid_from date, batch int, is_current boolean"
    first = indexed(spark.createDataFrame([], kinds), blocks, docs, "doc_id", 1)
    return indexed(first, blocks.where("doc_id % 5 = 0 and seq < 1"), docs, "doc_id", 2).select("doc_id", "seq", "batch", "is_current", "valid_from")


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'edit 2' ELSE c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'CT' END AS series, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS overrides FROM customer"""
)
def metadata_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Titles edited twice and series once; all edits stay in the log."""
    c = s.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.create_map(F.lit("title"), F.col("c_name")).alias("fields"))
    edit = lambda rows, field, value, at: rows.select("k", F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit("ed").alias("edited_by"), F.lit(at).alias("at"))
    even = c.where("k % 2 = 0")
    edits = edit(even, "title", "edit 1", 1).unionByName(edit(even, "title", "edit 2", 2)).unionByName(edit(c.where("k % 3 = 0"), "series", "CT", 1))
    got = w.with_overrides(c, edits, "k")
    return got.select("k", F.col("fields")["title"].alias("title"), F.try_element_at("fields", F.lit("series")).alias("series"), F.coalesce(F.size("overrides"), F.lit(0)).alias("overrides"))


@query("SELECT o_orderkey AS job, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'queued' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'not_found' WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'conflict' END AS outcome FROM orders")
def job_retries(spark: SparkSession, d: str) -> DataFrame:
    """All jobs are asked for again; only failed ones are queued."""
    from ..operators.workflow import decided

    orders = s.table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    jobs = orders.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("job"), state.alias("status"))
    return decided(jobs, orders.select(F.col("o_orderkey").alias("job"), F.lit("retry").alias("action")), "job", "job").select("job", "status", "outcome")


@query("SELECT n_nationkey AS instrument, CASE WHEN n_nationkey % 2 = 0 THEN 'verified' ELSE 'draft' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'conflict' END AS outcome FROM nation")
def baseline_verify(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.workflow import decided

    n = s.table(spark, d, "nation")
    things = n.select(F.col("n_nationkey").alias("instrument"), F.when(F.col("n_nationkey") % 2 == 0, "loaded").otherwise("draft").alias("status"))
    return decided(things, n.select(F.col("n_nationkey").alias("instrument"), F.lit("verify").alias("action")), "instrument", "baseline").select("instrument", "status", "outcome")
