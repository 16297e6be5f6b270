"""Queries in the language people type them in, over postings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import search as q
from ..operators import term_index
from ..session import dealt, shared_folder
from ..sources import tables as s
from .registry import BLOCKS, DOCS, query

WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS t FROM documents)"""


def _found(spark: SparkSession, d: str, asked: str) -> DataFrame:
    index = q.postings(s.table(spark, d, "documents"), "doc_id")
    return q.found(index, "doc_id", asked).select("doc_id")


@query(f"WITH {WORDS} SELECT doc_id FROM w WHERE list_contains(t, 'the') AND list_contains(t, 'from')")
def find_all_words(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "the from")


@query(f"WITH {WORDS} SELECT doc_id FROM w WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def find_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, '"of the"')


@query(f"WITH {WORDS} SELECT doc_id FROM w WHERE list_contains(t, 'und') OR (list_contains(t, 'que') AND list_contains(t, 'en'))")
def find_either(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "und OR que en")


@query(f"WITH {WORDS} SELECT doc_id FROM w WHERE list_contains(t, 'the') AND NOT contains(' ' || array_to_string(t, ' ') || ' ', ' in the ') AND NOT list_contains(t, 'for')")
def find_without(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, 'the -"in the" -for')


@query(f"WITH {WORDS} SELECT doc_id, round(0.4 * len(list_filter(t, lambda x: x = 'für')), 6) AS raw_rank FROM w WHERE list_contains(t, 'für')")
def cover_rank(spark: SparkSession, d: str) -> DataFrame:
    """Of one word every place is a cover; longer ones are tested against every span."""
    index = q.postings(s.table(spark, d, "documents"), "doc_id")
    return q.found(index, "doc_id", "für").select("doc_id", F.round("raw_rank", 6).alias("raw_rank"))


@query(f"WITH {DOCS} SELECT doc_id FROM docs WHERE doc_date <= DATE '2019-06-01' AND (doc_id % 3 <> 0 OR doc_date + 400 > DATE '2019-06-01') AND doc_type IN ('act', 'judgement') AND doc_date >= DATE '2018-01-01' UNION ALL SELECT doc_id FROM docs WHERE doc_type = 'rules' AND doc_id % 2 = 1 AND false")
def narrowed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that stand on a day, of some types, from a day on; every third ends after 400 days."""
    day = lambda x: F.lit(x).cast("date")
    rows = s.documents(spark, d).withColumn("valid_from", F.col("doc_date")).withColumn("valid_to", F.when(F.col("doc_id") % 3 == 0, F.date_add("doc_date", 400)))
    return q.narrowed(rows, day("2019-06-01"), doc_types=["act", "judgement"], first=day("2018-01-01")).select("doc_id")


@query(
    """SELECT p_partkey, 'r' || (p_partkey % 90 + 1) || '.4' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'x [-' || p_brand || '-]{+' || p_type || '+}' ELSE 'x ' || p_brand END AS diff, 'a b' AS plain, p_partkey % 90 + 1 AS n FROM part WHERE NOT contains(p_brand, ' ')
    AND NOT contains(p_type, ' ')"""
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The text functions under their SQL names."""
    sql.register(spark)
    dealt(s.table(spark, d, "part")).createOrReplaceTempView("lexloom_part")  # a small file would be read, and all of Python run, in one task
    return spark.sql(
        """SELECT p_partkey, legal_locator('sub-rule (4) of rule ' || (p_partkey % 90 + 1)).path AS path, word_diff('x ' || p_brand, 'x ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END) AS diff, normalise_text(' a  b ') AS plain,
        CAST(c.number AS BIGINT) AS n FROM lexloom_part JOIN LATERAL legal_citations('Notification No. ' || (p_partkey % 90 + 1) || '/2020-Central Tax') AS c WHERE NOT contains(p_brand, ' ') AND NOT contains(p_type, ' ')"""
    )


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as chunks, headed by the document's type; even judgements are of high courts, every third of one state."""
    rows = s.lines(s.documents(spark, d).where("doc_id is not null"))
    court = F.when((F.col("doc_type") == "judgement") & (F.col("doc_id") % 4 == 1), "HC")
    state = F.when(F.col("doc_id") % 3 == 2, "ka").otherwise("DL")
    ends = F.when(F.col("doc_id") % 3 == 0, F.date_add("doc_date", 400))
    return rows.select(
        (F.col("doc_id") * 1_000_000 + F.col("seq")).alias("chunk_id"), "doc_id", "seq", F.col("doc_type").alias("heading"), "text", "doc_type", "authority_rank", "status",
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_date")).alias("valid_from"), ends.alias("valid_to"), court.alias("court_level"), state.alias("state_code"),
    )


def _indexed(spark: SparkSession, d: str, english: bool) -> tuple[term_index.Reader, DataFrame]:
    """An index of all chunks, in which a second batch gives every tenth document anew, without its odd lines; and the chunks as they are then."""
    root = f"{shared_folder(spark)}/term-index-{uuid.uuid4().hex}"
    made = _chunks(spark, d)
    made.write.option("compression", "zstd").parquet(f"{root}/chunks")  # a search reads their columns again and again, and few of their texts
    chunks = spark.read.schema(made.schema).parquet(f"{root}/chunks")
    tenth = F.col("doc_id") % 10 == 0
    term_index.add(spark, root, chunks, english)
    term_index.add(spark, root, chunks.where(tenth & (F.col("seq") % 2 == 0)), english)
    return term_index.Reader(spark, root), chunks


#: The 200 best chunks by a rank from headings and words (of one wanted word it is the sum of its weights, 1.0 in headings and 0.4 in texts), then each document's best.
_INDEXED = r"""c0 AS (SELECT b.doc_id, b.doc_id * 1000000 + b.seq AS chunk_id, d.doc_type, authority_rank, status, CASE WHEN d.doc_id % 5 <> 0 THEN doc_date END AS valid_from, CASE WHEN d.doc_id % 3 = 0 THEN doc_date + 400 END AS valid_to,
  d.doc_type = 'judgement' AND d.doc_id % 4 = 1 AS high, d.doc_id % 3 = 2 AS own, regexp_extract_all(lower(b.text), '[\p{L}\p{N}\p{M}]+') AS t FROM blocks b JOIN docs d USING (doc_id) WHERE NOT (b.doc_id % 10 = 0 AND b.seq % 2 = 1)),
c AS (SELECT *, RANK AS raw_rank FROM c0 WHERE (valid_from IS NULL OR valid_from <= DATE '2019-06-01') AND (valid_to IS NULL OR valid_to > DATE '2019-06-01')),
hits AS (SELECT * FROM c WHERE raw_rank > 0 ORDER BY raw_rank DESC, chunk_id LIMIT 200),
scored AS (SELECT *, round(raw_rank * CASE authority_rank WHEN 2 THEN 1.25 WHEN 4 THEN 1.15 WHEN 5 THEN 1.12 WHEN 6 THEN 1.08 WHEN 8 THEN 1.0 END * CASE WHEN high THEN CASE WHEN own THEN 1.15 ELSE 0.95 END ELSE 1.0 END
  * CASE WHEN doc_type IN ('judgement', 'circular', 'order') AND DATE '2019-06-01' - valid_from BETWEEN 0 AND 1095 THEN 1.05 ELSE 1.0 END * CASE WHEN status IN ('superseded', 'rescinded', 'struck_down') THEN 0.5 WHEN status = 'stayed' THEN 0.7 ELSE 1.0 END, 4) AS score FROM hits),
best AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS passages, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS place FROM scored) WHERE place = 1)"""
_SIMPLE = _INDEXED.replace("RANK", "CASE WHEN list_contains(t, 'für') <> list_contains(t, 'and') AND NOT contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') THEN 0.4 * len(list_filter(t, lambda x: x IN ('für', 'and'))) ELSE 0 END")
_TIONS = "CASE WHEN doc_type <> 'act' AND NOT list_contains(t, 'act') THEN 0.4 * len(list_filter(t, lambda x: regexp_full_match(x, 'tion(ly)?(s|es|ed|ing|ings|ly|edly|ingly)?'))) ELSE 0.0 END"
_RULES = "CASE WHEN doc_type = 'rules' THEN 1.0 ELSE 0.0 END + 0.4 * len(list_filter(t, lambda x: x IN ('rule', 'rules', 'ruled')))"
_ENGLISH = _INDEXED.replace("RANK", f"greatest({_RULES}, {_TIONS})")
_ON = "2019-06-01"


@query(f"WITH {BLOCKS}, {_SIMPLE} SELECT doc_id, chunk_id, score, passages FROM best ORDER BY score DESC, doc_id LIMIT 40 OFFSET 5")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a search over the stored index: one word or another but not both, and not a phrase."""
    index, chunks = _indexed(spark, d, english=False)
    items, _, _ = term_index.search(index, chunks, 'für -and -"of the" OR and -für -"of the"', F.lit(_ON).cast("date"), limit=40, offset=5, user_state="KA")
    return items.select("doc_id", "chunk_id", "score", "passages")


@query(f"WITH {BLOCKS}, {_ENGLISH} SELECT doc_id, chunk_id, score, passages FROM best ORDER BY score DESC, doc_id LIMIT 100")
def search_english(spark: SparkSession, d: str) -> DataFrame:
    """The same in English: words meet by their stems, headings count more, and a word comes as another one's synonym."""
    index, chunks = _indexed(spark, d, english=True)
    items, _, _ = term_index.search(index, chunks, "tions -acting", F.lit(_ON).cast("date"), limit=100, user_state="KA", synonyms={"tions": ["ruling"]})
    return items.select("doc_id", "chunk_id", "score", "passages")


@query(
    f"""WITH {BLOCKS}, {_INDEXED.replace("RANK", _TIONS)}, g AS (SELECT CASE WHEN doc_type IN ('act', 'rules') THEN 'provisions' WHEN doc_type = 'notification' THEN 'notifications' WHEN doc_type IN ('circular', 'order') THEN 'circulars' WHEN doc_type = 'judgement' THEN 'judgements' END AS bucket, count(*) AS n FROM best GROUP BY 1)
    SELECT v.bucket, coalesce(n, 0) AS n FROM (VALUES ('provisions'), ('notifications'), ('circulars'), ('judgements')) v(bucket) LEFT JOIN g ON g.bucket = v.bucket"""
)
def search_english_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of that search without the synonym; a heading's word, found by its stem, excludes acts."""
    index, chunks = _indexed(spark, d, english=True)
    return term_index.search(index, chunks, "tions -acting", F.lit(_ON).cast("date"), user_state="KA")[1]
