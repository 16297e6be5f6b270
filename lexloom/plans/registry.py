"""The queries and, where SQL can say the same, the SQL that must give their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


#: The relations of lexloom.sources.tables, said again in SQL for the oracles.
VERSIONS = """v0 AS (SELECT o_custkey AS provision_id, CAST(o_orderdate AS DATE) AS valid_from, min(o_orderkey) AS version_id FROM orders GROUP BY 1, 2),
versions AS (SELECT provision_id, valid_from, version_id, lead(valid_from) OVER (PARTITION BY provision_id ORDER BY valid_from) AS valid_to,
  valid_from AS rec_from, CASE WHEN version_id % 11 = 0 THEN valid_from + 30 END AS rec_to,
  'version ' || version_id || ' of ' || provision_id AS text FROM v0)"""
DOCS = """docs AS (SELECT doc_id, text, source, ['act','rules','notification','circular','order','judgement'][doc_id % 6 + 1] AS doc_type,
  [2,4,5,8,8,6][doc_id % 6 + 1] AS authority_rank, DATE '2017-07-01' + CAST(doc_id % 1000 AS INTEGER) AS doc_date,
  ['in_force','amended','superseded','rescinded','struck_down','stayed','in_force'][doc_id % 7 + 1] AS status FROM documents)"""
BLOCKS = (
    DOCS
    + """, l0 AS (SELECT doc_id, doc_type, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM docs),
blocks AS (SELECT doc_id, doc_type, seq, lines[seq + 1] AS text, CASE WHEN seq = 0 THEN 'pre' ELSE 'p' || seq END AS path
  FROM (SELECT doc_id, doc_type, lines, unnest(range(len(lines))) AS seq FROM l0))"""
)
JOBS = """jobs AS (SELECT event_id, user_id % 7 AS source,
  CASE event_type WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'skipped' WHEN 'signup' THEN 'queued' END AS status,
  ts AS discovered_at, CASE WHEN event_type = 'click' THEN ts + to_minutes(CAST(floor(value) AS BIGINT) % 3000) END AS published_at FROM events),
moment AS (SELECT max(ts) AS now_at FROM events)"""
SOURCES = """sources AS (SELECT source, max(CASE WHEN event_id % 97 = source AND source <> 6 THEN discovered_at END) AS last_new_doc_at, source % 3 + 1 AS cadence_hours FROM jobs GROUP BY source)"""
QUEUE = """queue AS (SELECT event_id, user_id % 5 AS queue, ts AS run_after, ts - to_hours(CAST(event_id % 3 AS INTEGER)) AS created_at FROM events WHERE event_type = 'signup')"""
TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey AS subject_id,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'amendment' WHEN '3' THEN 'parse_failure' WHEN '4' THEN 'miss_report' WHEN '5' THEN 'treatment' ELSE 'metadata' END AS kind,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_review' WHEN 'F' THEN 'done' ELSE 'rejected' END AS status,
  o_orderdate AS opened_at, o_orderdate + INTERVAL 8 HOUR AS sla_due_at, o_orderkey % 5 AS priority FROM orders),
later AS (SELECT max(o_orderdate) AS now_at FROM orders)"""
PAGES = (
    BLOCKS
    + """, g0 AS (SELECT doc_id, seq AS page_no, length(text) AS chars_a, greatest(length(text) - doc_id % 20, 0) AS chars_b FROM blocks),
pages_ AS (SELECT *, CASE WHEN chars_a < 20 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'ocr' ELSE 'text' END AS method,
  CASE WHEN chars_a < 20 THEN 'failed' ELSE 'ok' END AS status, abs(chars_a - chars_b) > 10 AS flagged FROM g0)"""
)
LINKS = """links AS (SELECT 'document' AS src_type, l_partkey AS src_id, CASE WHEN l_linenumber % 7 = 0 THEN 'document' ELSE 'provision' END AS dst_type,
  l_suppkey AS dst_id, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'amends' WHEN 'NF' THEN 'interprets' WHEN 'RF' THEN 'clarifies' WHEN 'NO' THEN (CASE l_linenumber % 3 WHEN 0 THEN 'mentions' WHEN 1 THEN 'cites' ELSE 'issued_under' END) ELSE 'substitutes' END AS link_type FROM lineitem)"""
