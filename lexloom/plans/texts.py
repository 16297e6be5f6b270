"""Blocks, text functions, chunks, duplicates and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import chunking as c
from ..operators import dedup as dd
from ..operators import search as q
from ..session import cut, dealt
from ..sources import tables as s
from .registry import BLOCKS, DOCS, VERSIONS, query


@query(f"WITH {BLOCKS} SELECT doc_id, seq, path, text FROM blocks")
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return s.blocks(spark, d).select("doc_id", "seq", "path", "text")


PIECES = r"list_filter(string_split_regex(trim({0}, ' '), '\s+'), lambda x: x <> '')"
TOKENS = f"CASE WHEN {{0}} = '' THEN 0 ELSE greatest(1, CAST(floor(len({PIECES}) * 1.25) AS BIGINT)) END"


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens, sha256(text) AS digest, substr(text, 1, 200) AS snippet FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").select("doc_id", x.count_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("digest"), F.substring("text", 1, 200).alias("snippet"))


LANG = r"""l AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{0900}-\x{0963}\x{0970}-\x{097F}]')) AS hindi, len(regexp_extract_all(text, '[\p{L}\x{0900}-\x{0963}\x{0970}-\x{097F}]')) AS letters FROM documents)"""


@query(f"WITH {LANG} SELECT doc_id, CASE WHEN letters = 0 THEN NULL WHEN hindi / letters > 0.3 THEN 'hi' ELSE 'en' END AS lang FROM l")
def lang_letters(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").select("doc_id", x.detect_lang(F.col("text")).alias("lang"))


@query(
    rf"""WITH g AS (SELECT doc_id, len(regexp_extract_all(text, '\S')) AS solid, len(regexp_extract_all(text, '[\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]')) + 5 * len(regexp_extract_all(text, '\(cid:[0-9]+\)')) AS bad,
    {PIECES.format("text")} AS w FROM documents)
    SELECT doc_id, round(CASE WHEN solid = 0 THEN 0 ELSE least(1, bad / solid + 0.5 * len(list_filter(w, lambda x: len(regexp_extract_all(x, '[^\p{{L}}\p{{N}}_]')) / len(x) > 0.4)) / len(w)) END, 6) AS garble FROM g"""
)
def garble_ascii(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").select("doc_id", F.round(x.garble_score(F.col("text")), 6).alias("garble"))


@query(
    rf"""WITH {BLOCKS}, n AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN '(' || chr(97 + CAST(seq % 26 AS INTEGER)) || ') ' WHEN 1 THEN seq || '. ' WHEN 2 THEN 'iv) ' ELSE '' END || text AS text FROM blocks)
    SELECT doc_id, seq, regexp_replace(regexp_extract(text || ' ', '^(\(?(?:[0-9]{{1,3}}|[a-z]{{1,3}}|[ivxlc]{{1,6}})[.)])\s', 1), '\.$', '') AS label FROM n"""
)
def para_labels(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("("), F.char(97 + F.col("seq") % 26), F.lit(") "))).when(F.col("seq") % 4 == 1, F.concat(F.col("seq").cast("string"), F.lit(". "))).when(F.col("seq") % 4 == 2, "iv) ").otherwise("")
    return s.blocks(spark, d).select("doc_id", "seq", x.para_label(F.concat(lead, "text")).alias("label"))


@query(
    """SELECT c_custkey AS k, 'The Act > Chapter ' || c_nationkey || CASE c_custkey % 4 WHEN 0 THEN ' > s.' || c_custkey || ' > (' || c_custkey % 9 || ') > (iv)' WHEN 1 THEN ' > r.' || c_custkey || ' > Proviso 2'
    WHEN 2 THEN ' > s' || c_custkey || 'A > Explanation 1' ELSE ' > Schedule 3' END || CASE WHEN c_custkey % 2 = 0 THEN ' - ' || c_mktsegment ELSE '' END AS heading_path FROM customer"""
)
def heading_paths(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    kinds = [F.concat(F.lit(".s"), key, F.lit("."), (F.col("c_custkey") % 9).cast("string"), F.lit(".iv")), F.concat(F.lit(".r"), key, F.lit(".prov2")), F.concat(F.lit(".s"), key, F.lit("A.expl")), F.lit(".sched3")]
    path = F.concat(F.lit("ch"), F.col("c_nationkey").cast("string"), F.element_at(F.array(*kinds), (F.col("c_custkey") % 4 + 1).cast("int")))
    return s.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), x.heading_path(F.lit("The Act"), path, F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("heading_path"))


@query(f"WITH {BLOCKS} SELECT doc_id, 'other' AS chunk_kind, path AS chunk_path, text, {TOKENS.format('text')} AS tokens FROM blocks WHERE doc_type = 'act'")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return c.one_each(s.blocks(spark, d).where("doc_type = 'act'"))


def _labelled(spark: SparkSession, d: str, path, *types: str) -> DataFrame:
    """Blocks of documents of some types with a path, a label and their document's title."""
    rows = s.blocks(spark, d).where(F.col("doc_type").isin(*types))
    return rows.withColumn("path", path).withColumn("label", F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string"))).withColumn("title", F.concat(F.lit("D"), F.col("doc_id").cast("string"))).withColumn("subject", F.when(F.col("doc_id") % 4 == 0, "refunds"))


@query(
    f"""WITH {BLOCKS}, g AS (SELECT doc_id, CASE WHEN seq = 0 OR seq % 7 = 0 THEN 'pre' ELSE 'p' || seq // 3 END AS root, min(seq) AS first_seq, max(seq) AS last_seq, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM blocks WHERE doc_type = 'notification' GROUP BY 1, 2),
    h AS (SELECT *, CASE WHEN root = 'pre' THEN 'pre' WHEN doc_id % 4 = 0 THEN root || '.i' || first_seq ELSE root END AS path, CASE WHEN root <> 'pre' THEN CASE WHEN first_seq % 2 = 0 THEN CAST(first_seq AS VARCHAR) ELSE root END END AS para_label FROM g)
    SELECT doc_id, CASE WHEN root = 'pre' THEN 'preamble' WHEN doc_id % 4 = 0 THEN 'amendment_instruction' ELSE 'paragraph' END AS chunk_kind, path AS chunk_path, para_label,
    'D' || doc_id || CASE WHEN root = 'pre' THEN ' > Preamble' ELSE ' > ' || path || CASE WHEN para_label <> path THEN ' > Para ' || para_label ELSE '' END END AS heading_path, first_seq, last_seq, text, {TOKENS.format("text")} AS tokens FROM h"""
)
def chunk_notification(spark: SparkSession, d: str) -> DataFrame:
    item = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(".i"), F.col("seq").cast("string"))).otherwise("")
    path = F.when((F.col("seq") == 0) | (F.col("seq") % 7 == 0), "pre").otherwise(F.concat(F.lit("p"), F.floor(F.col("seq") / 3).cast("string"), item))
    return c.notification(_labelled(spark, d, path, "notification")).select(*c.CHUNK)


@query(
    f"""WITH {VERSIONS}, h AS (SELECT version_id, provision_id, text, CASE WHEN version_id % 2 = 0 THEN 'Heading ' || provision_id END AS heading, 'CGST Act > s.' || provision_id || CASE WHEN version_id % 2 = 0 THEN ' - Heading ' || provision_id ELSE '' END AS heading_path FROM versions)
    SELECT version_id, 'provision' AS chunk_kind, heading_path, text, 2 AS authority_rank FROM h UNION ALL SELECT version_id, 'section_summary', heading_path, heading || ': ' || text, 2 FROM h WHERE heading IS NOT NULL AND provision_id % 3 <> 0"""
)
def chunk_provisions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("provision_id").cast("string")
    heading = F.when(F.col("version_id") % 2 == 0, F.concat(F.lit("Heading "), key))
    level = F.when(F.col("provision_id") % 3 == 0, "clause").otherwise("section")
    return c.of_provisions(s.versions(spark, d).select("version_id", "text", heading.alias("heading"), level.alias("level"), F.lit("CGST Act").alias("instrument"), F.concat(F.lit("s"), key).alias("path")), 2)


WALK = r"""walk AS (SELECT k, doc_id, seq, n AS size, 0 AS part FROM b WHERE nth = 1
    UNION ALL SELECT b.k, b.doc_id, b.seq, CASE WHEN {full} w.size + b.n > 500 THEN b.n ELSE w.size + b.n END, w.part + CASE WHEN {full} w.size + b.n > 500 THEN 1 ELSE 0 END FROM walk w JOIN b0 ON b0.k = w.k AND b0.seq = w.seq JOIN b ON b.k = w.k AND b.nth = b0.nth + 1)"""
BODY = r"""b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS nth FROM rows_), b0 AS (SELECT k, seq, nth FROM b)"""


@query(
    rf"""WITH RECURSIVE {BLOCKS}, rows_ AS (SELECT doc_id AS k, doc_id, seq, text, len({PIECES.format("text")}) AS n FROM blocks WHERE doc_type IN ('circular', 'order') AND seq >= 2), {BODY},
    {WALK.format(full="w.size >= 80 OR")},
    g AS (SELECT w.doc_id, min(w.seq) AS first_seq, max(w.seq) AS last_seq, string_agg(b.text, chr(10) || chr(10) ORDER BY b.seq) AS text, min(CASE WHEN w.seq % 2 = 0 THEN w.seq END) AS label FROM walk w JOIN b ON b.k = w.k AND b.seq = w.seq GROUP BY w.doc_id, part),
    h AS (SELECT doc_id, 'paragraph' AS chunk_kind, 'p' || first_seq AS chunk_path, 'D' || doc_id || ' > p' || first_seq || CASE WHEN label IS NOT NULL THEN ' > Para ' || label ELSE '' END AS heading_path, CAST(label AS VARCHAR) AS para_label, first_seq, last_seq,
    CASE WHEN doc_id % 4 = 0 THEN 'Subject: refunds' || chr(10) || chr(10) ELSE '' END || text AS text FROM g
    UNION ALL SELECT doc_id, 'header', 'hdr', 'D' || doc_id || ' > Header', NULL, min(seq), max(seq), string_agg(text, chr(10) || chr(10) ORDER BY seq) FROM blocks WHERE doc_type IN ('circular', 'order') AND seq < 2 GROUP BY 1)
    SELECT *, {TOKENS.format("text")} AS tokens FROM h"""
)
def chunk_circular(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("seq") < 2, "hdr").otherwise(F.concat(F.lit("p"), F.col("seq").cast("string")))
    return c.circular(_labelled(spark, d, path, "circular", "order")).select(*c.CHUNK)


@query(
    rf"""WITH RECURSIVE {BLOCKS}, rows_ AS (SELECT doc_id || CASE WHEN seq % 9 < 5 THEN 'facts' ELSE 'order' END AS k, doc_id, seq, text, len({PIECES.format("text")}) AS n FROM blocks WHERE doc_type = 'judgement' AND seq > 0), {BODY},
    {WALK.format(full="")},
    g AS (SELECT w.k, w.doc_id, min(w.seq) AS first_seq, max(w.seq) AS last_seq, string_agg(b.text, chr(10) || chr(10) ORDER BY b.seq) AS text, list(w.seq ORDER BY w.seq) FILTER (w.seq % 2 = 0) AS labels FROM walk w JOIN b ON b.k = w.k AND b.seq = w.seq GROUP BY w.k, w.doc_id, part),
    h AS (SELECT doc_id, substr(k, length(k) - 4) AS chunk_kind, first_seq, last_seq, text, CASE WHEN len(labels) > 1 THEN 'paras ' || labels[1] || '-' || labels[-1] WHEN len(labels) = 1 THEN CAST(labels[1] AS VARCHAR) END AS para_label FROM g)
    SELECT doc_id, chunk_kind, chunk_kind || '.p' || first_seq AS chunk_path, 'D' || doc_id || ' > ' || CASE chunk_kind WHEN 'facts' THEN 'Facts' ELSE 'Order' END || coalesce(' > ' || para_label, '') AS heading_path, para_label, first_seq, last_seq, text, {TOKENS.format("text")} AS tokens FROM h
    UNION ALL SELECT doc_id, 'header', 'hdr', 'D' || doc_id || ' > Header', NULL, seq, seq, text, {TOKENS.format("text")} FROM blocks WHERE doc_type = 'judgement' AND seq = 0"""
)
def chunk_judgement(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("seq") % 9 < 5, "facts").otherwise("order")
    path = F.when(F.col("seq") == 0, "hdr").otherwise(F.concat(part, F.lit(".p"), F.col("seq").cast("string")))
    return c.judgement(_labelled(spark, d, path, "judgement")).select(*c.CHUNK)


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dupes(spark: SparkSession, d: str) -> DataFrame:
    return dd.exact_groups(s.table(spark, d, "documents"))


HASHES = (
    r"""w0 AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM documents),
w1 AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS b FROM w0),
hashes AS (SELECT doc_id, """
    + " + ".join(f"(CASE WHEN 2 * sum((b >> {k}) & 1) > count(*) THEN {1 << k} ELSE 0 END)" for k in range(60))
    + """ AS simhash FROM w1 GROUP BY 1), all_hashes AS (SELECT doc_id, coalesce(simhash, 0) AS simhash FROM documents LEFT JOIN hashes USING (doc_id)),
classes AS (SELECT simhash, min(doc_id) AS a FROM all_hashes GROUP BY 1),
pairs AS (SELECT x.a AS a, y.a AS b, bit_count(xor(x.simhash, y.simhash)) AS distance FROM classes x JOIN classes y ON x.a < y.a AND bit_count(xor(x.simhash, y.simhash)) <= 3
UNION ALL SELECT a, doc_id, 0 FROM all_hashes JOIN classes USING (simhash) WHERE doc_id <> a),
near AS (SELECT x.doc_id AS a, y.doc_id AS b FROM all_hashes x JOIN all_hashes y ON x.doc_id < y.doc_id AND x.doc_id % 2 = y.doc_id % 2 AND bit_count(xor(x.simhash, y.simhash)) <= 3)"""
)


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """Every document in one block: the whole table is compared."""
    return dd.hashed_bits(s.table(spark, d, "documents")).withColumn("block", F.lit(0))


@query(f"WITH {HASHES} SELECT a, b, distance FROM pairs")
def near_dupes_md5(spark: SparkSession, d: str) -> DataFrame:
    return dd.near_pairs(_hashes(spark, d), "block")


@query()
def near_dupes(spark: SparkSession, d: str) -> DataFrame:
    """The same join on 64-bit hashes of word shingles, over the whole table, which SQL cannot compute; tests compare it with brute force."""
    hashes = s.table(spark, d, "documents").select("doc_id", F.lit(0).alias("block"), x.simhash64("text").alias("simhash"))
    return dd.near_pairs(cut(hashes), "block")  # stored: the join uses them more than once, and Python hashes each text once


@query(f"WITH {HASHES} SELECT b AS doc_id, min(a) AS target FROM near GROUP BY 1")
def merge_targets(spark: SparkSession, d: str) -> DataFrame:
    return dd.merge_targets(_hashes(spark, d), s.table(spark, d, "documents").withColumn("number", F.col("doc_id") % 2), "block", "number")


@query(f"WITH {HASHES}, t AS (SELECT b AS doc_id, min(a) AS target FROM near GROUP BY 1) SELECT coalesce(target, doc_id) AS target, doc_id, row_number() OVER (PARTITION BY coalesce(target, doc_id) ORDER BY doc_id) AS version_no FROM documents LEFT JOIN t USING (doc_id)")
def version_renumber(spark: SparkSession, d: str) -> DataFrame:
    docs = s.table(spark, d, "documents").withColumn("number", F.col("doc_id") % 2)
    return dd.renumbered(docs, dd.merge_targets(_hashes(spark, d), docs, "block", "number"))


@query(
    r"""WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark), e AS (SELECT item_id, w, count(*) AS want FROM w GROUP BY 1, 2),
    f AS (SELECT item_id, w, count(*) AS have FROM (SELECT doc_id AS item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY 1, 2)
    SELECT item_id, CAST(sum(want) AS BIGINT) AS want, CAST(sum(least(want, coalesce(have, 0))) AS BIGINT) AS have, round(sum(least(want, coalesce(have, 0))) / sum(want), 6) AS recall FROM e LEFT JOIN f USING (item_id, w) GROUP BY 1"""
)
def word_recall(spark: SparkSession, d: str) -> DataFrame:
    return dd.word_recall(s.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), s.table(spark, d, "benchmark"), "item_id")


@query(r"SELECT term, doc_id, count(*) AS tf, min(p) AS first_position FROM (SELECT doc_id, t[p + 1] AS term, p FROM (SELECT doc_id, t, unnest(range(len(t))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS t FROM documents))) GROUP BY 1, 2")
def postings(spark: SparkSession, d: str) -> DataFrame:
    """Texts are dealt by their ids, so each meets its own words in one task and no word is shuffled."""
    docs = s.table(spark, d, "documents").select("doc_id", "text")
    return q.postings(dealt(docs, "doc_id", rows=q.TEXTS), "doc_id").select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_position"))


ASKED = ["the", "of"]
HITS = r"""w AS (SELECT doc_id, doc_type, seq, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM blocks),
hits AS (SELECT doc_id, doc_type, seq, round((len(list_filter(t, lambda x: x = 'the')) + len(list_filter(t, lambda x: x = 'of'))) / (1 + ln(len(t))), 9) AS raw_rank FROM w WHERE list_contains(t, 'the') AND list_contains(t, 'of')),
scored AS (SELECT h.*, raw_rank * CASE authority_rank WHEN 2 THEN 1.25 WHEN 4 THEN 1.15 WHEN 5 THEN 1.12 WHEN 6 THEN 1.08 WHEN 8 THEN 1.0 END
* CASE WHEN h.doc_type = 'judgement' AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.15 ELSE 0.95 END ELSE 1.0 END
* CASE WHEN h.doc_type IN ('judgement', 'circular', 'order') AND DATE '2020-01-01' - doc_date BETWEEN 0 AND 1095 THEN 1.05 ELSE 1.0 END
* CASE WHEN status IN ('superseded', 'rescinded', 'struck_down') THEN 0.5 WHEN status = 'stayed' THEN 0.7 ELSE 1.0 END AS score FROM hits h JOIN docs USING (doc_id))"""


def _scored(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    """Hits with their score: even judgements are of high courts, every third of them of the user's own state."""
    hits = q.matches(s.blocks(spark, d), "doc_id", ASKED)
    if most:
        hits = hits.orderBy(F.desc("raw_rank"), "doc_id", "seq").limit(most)
    docs = s.documents(spark, d).select("doc_id", "authority_rank", "status", "doc_date")
    court, state = F.when(F.col("doc_id") % 2 == 0, "HC"), F.when(F.col("doc_id") % 3 == 0, "ka").otherwise("DL")
    return hits.join(docs, "doc_id").withColumn("score", q.adjusted(F.col("raw_rank"), F.col("authority_rank"), F.col("status"), F.col("doc_type"), F.col("doc_date"), F.lit("2020-01-01").cast("date"), court, state, F.lit("KA")))


@query(f"WITH {BLOCKS}, {HITS} SELECT doc_id, seq, raw_rank FROM hits ORDER BY raw_rank DESC, doc_id, seq LIMIT 200")
def search_top(spark: SparkSession, d: str) -> DataFrame:
    return q.matches(s.blocks(spark, d), "doc_id", ASKED).select("doc_id", "seq", "raw_rank").orderBy(F.desc("raw_rank"), "doc_id", "seq").limit(q.CANDIDATES)


@query(f"WITH {BLOCKS}, {HITS} SELECT doc_id, seq, round(score, 6) AS score FROM scored")
def adjusted_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "seq", F.round("score", 6).alias("score"))


@query(
    f"""WITH {BLOCKS}, {HITS}, top AS (SELECT * FROM scored ORDER BY raw_rank DESC, doc_id, seq LIMIT 200)
    SELECT doc_id, seq, round(score, 6) AS score, passages FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS passages, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, seq) AS n FROM top) WHERE n = 1"""
)
def search_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best chunks, then each document's best of them."""
    scored = _scored(spark, d, q.CANDIDATES).withColumn("score", F.round("score", 6))
    return q.collapsed(scored, "doc_id", "score", "seq").select("doc_id", "seq", "score", "passages")


@query(
    f"""WITH {BLOCKS}, {HITS}, g AS (SELECT CASE WHEN doc_type IN ('act', 'rules') THEN 'provisions' WHEN doc_type = 'notification' THEN 'notifications' WHEN doc_type IN ('circular', 'order') THEN 'circulars' WHEN doc_type = 'judgement' THEN 'judgements' END AS bucket, count(DISTINCT doc_id) AS n FROM hits GROUP BY 1)
    SELECT v.bucket, coalesce(n, 0) AS n FROM (VALUES ('provisions'), ('notifications'), ('circulars'), ('judgements')) v(bucket) LEFT JOIN g ON g.bucket = v.bucket"""
)
def search_groups(spark: SparkSession, d: str) -> DataFrame:
    return q.group_counts(_scored(spark, d).select("doc_id", "doc_type").distinct())


SYNONYMS = {"BRAND": ["make", "trade name"], "name 1": ["first name", "make"]}


@query(
    """SELECT p_partkey, asked || CASE WHEN hit AND one THEN ' OR ("make" OR "trade name" OR "first name")' WHEN hit THEN ' OR ("make" OR "trade name")' WHEN one THEN ' OR ("first name" OR "make")' ELSE '' END AS expanded
    FROM (SELECT p_partkey, asked, regexp_matches(asked, '(?i)\\bbrand\\b') AS hit, regexp_matches(asked, '(?i)\\bname 1\\b') AS one FROM (SELECT p_partkey, p_brand || ' name ' || p_partkey % 3 AS asked FROM part))"""
)
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat("p_brand", F.lit(" name "), (F.col("p_partkey") % 3).cast("string"))
    return s.table(spark, d, "part").select("p_partkey", q.expanded(asked, SYNONYMS).alias("expanded"))


@query(f"WITH {DOCS} SELECT doc_id, doc_type, doc_date, status FROM docs WHERE doc_date <= DATE '2018-06-01' AND status IN ('in_force', 'amended')")
def document_filter(spark: SparkSession, d: str) -> DataFrame:
    return s.documents(spark, d).where((F.col("doc_date") <= F.lit("2018-06-01").cast("date")) & F.col("status").isin("in_force", "amended")).select("doc_id", "doc_type", "doc_date", "status")
