"""Queries on legal text. The tables hold none, so texts are made from their rows or given as literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amend, ids
from ..functions.text import normalise_text, word_diff
from ..operators import amendments, fields, law, segments
from ..operators.folds import arrow_udf
from ..session import cut
from ..sources import tables as s
from .registry import VERSIONS, query


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each part that cites a section, and for some a rule or a notification."""
    p = s.table(spark, d, "part")
    number, clause = (F.col("p_partkey") % 90 + 1).cast("string"), F.char(97 + F.col("p_partkey") % 5)
    text = F.concat(F.lit("Relief under section "), number, F.lit("(2)("), clause, F.lit(") of the "), F.when(F.col("p_partkey") % 2 == 0, "CGST Act").otherwise("IGST Act"))
    text = F.concat(text, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" read with Notification No. "), number, F.lit("/2020-Central Tax"))).otherwise(""))
    return p.select("p_partkey", text.alias("text"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey % 90 + 1 AS n, chr(CAST(97 + p_partkey % 5 AS INTEGER)) AS c, CASE WHEN p_partkey % 2 = 0 THEN 'CGST_ACT' ELSE 'IGST_ACT' END AS i FROM part)
    SELECT p_partkey, 'section' AS kind, 'prov:' || i || ':s' || n || '.2.' || c AS canonical_id FROM p UNION ALL SELECT p_partkey, 'notification', 'ntf:CT:' || n || '/2020' FROM p WHERE p_partkey % 3 = 0"""
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    return law.citations(_cited(spark, d), "p_partkey").select("p_partkey", "kind", "canonical_id")


@query(
    """WITH p AS (SELECT p_partkey, CAST(p_partkey % 90 + 1 AS VARCHAR) AS n, CAST(p_partkey % 70 + 1 AS VARCHAR) AS r, p_partkey % 6 AS form FROM part),
    t AS (SELECT p_partkey, 'section' AS kind, 's' || n AS path, CASE form WHEN 0 THEN 'CGST_ACT' WHEN 1 THEN 'IGST_ACT' WHEN 2 THEN 'UTGST_ACT' WHEN 3 THEN NULL WHEN 4 THEN 'CGST_ACT' ELSE NULL END AS instrument FROM p
      UNION ALL SELECT p_partkey, 'rule', 'r' || r, CASE form WHEN 0 THEN 'IGST_RULES' WHEN 1 THEN 'IGST_RULES' WHEN 2 THEN 'CGST_RULES' WHEN 3 THEN NULL ELSE 'CGST_RULES' END FROM p WHERE form < 5)
    SELECT p_partkey, kind, 'prov:' || instrument || ':' || path AS canonical_id, CASE WHEN instrument IS NULL THEN array_to_string(list_transform(['CGST', 'IGST', 'UTGST'], lambda f: 'prov:' || f || CASE kind WHEN 'rule' THEN '_RULES:' ELSE '_ACT:' END || path), ' ') ELSE '' END AS candidates,
    CASE WHEN instrument IS NULL THEN 0.6 ELSE 0.9 END AS confidence FROM t
    UNION ALL SELECT p_partkey, 'notification', 'ntf:' || CASE WHEN p_partkey % 4 < 2 THEN 'COMP(R)' ELSE 'COMP' END || ':' || n || '/2017', '', 0.95 FROM p WHERE form = 5"""
)
def citations_apart(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with two provisions: each of its own instrument, both of a shared one, of none, or of one too far away; and cess notifications."""
    p = s.table(spark, d, "part")
    n, r = (F.col("p_partkey") % 90 + 1).cast("string"), (F.col("p_partkey") % 70 + 1).cast("string")
    both = F.concat(F.lit("section "), n, F.lit(" and rule "), r)
    series = F.when(F.col("p_partkey") % 4 < 2, "Compensation Cess (Rate)").otherwise("Compensation Cess")
    forms = [
        F.concat(F.lit("section "), n, F.lit(" of the CGST Act and rule "), r, F.lit(" of the IGST Rules")),
        F.concat(F.lit("Under "), both, F.lit(" IGST")),
        F.concat(F.lit("s. "), n, F.lit(" of the Union Territory Goods and Services Tax Act, read with rule "), r, F.lit(" of the Central GST Rules")),
        F.concat(F.lit("The CGST Act says much; but see "), both),
        F.concat(both, F.lit(" of the CGST Rules, unlike anything in the IGST Act")),
        F.concat(F.lit("section "), n, F.lit(" in words that go on for longer than forty characters, CGST; Notification No. "), n, F.lit("/2017-"), series),
    ]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    return law.citations(p.select("p_partkey", text.alias("text")), "p_partkey").select("p_partkey", "kind", "canonical_id", F.array_join("candidates", " ").alias("candidates"), "confidence")


def _provisions(spark: SparkSession, d: str) -> DataFrame:
    c = s.table(spark, d, "customer")
    path = F.concat(F.lit("ch"), F.col("c_nationkey").cast("string"), F.lit(".s"), (F.col("c_custkey") % 60 + 1).cast("string"), F.lit(".2."), F.char(97 + F.col("c_custkey") % 5))
    return c.select(F.col("c_custkey").alias("provision_id"), F.lit("CGST_ACT").alias("instrument"), path.alias("path"))


@query(
    """WITH t AS (SELECT c_custkey % 60 + 1 AS n, c_custkey % 5 AS c, min(c_custkey) AS provision_id FROM customer GROUP BY 1, 2)
    SELECT DISTINCT p_partkey, provision_id FROM part JOIN t ON n = p_partkey % 90 + 1 AND c = p_partkey % 5 WHERE p_partkey % 2 = 0"""
)
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return law.mentions(law.citations(_cited(spark, d), "p_partkey"), _provisions(spark, d), "p_partkey")


@query(
    """WITH t AS (SELECT c_custkey % 60 + 1 AS n, c_custkey % 5 AS c, min(c_custkey) AS provision_id FROM customer GROUP BY 1, 2)
    SELECT p_partkey, 'prov:' || CASE WHEN p_partkey % 2 = 0 THEN 'CGST' ELSE 'IGST' END || '_ACT:s' || p_partkey % 90 + 1 || '.2.' || chr(CAST(97 + p_partkey % 5 AS INTEGER)) AS canonical_id,
    CASE WHEN p_partkey % 2 = 0 THEN provision_id END AS entity, CASE WHEN p_partkey % 2 = 0 AND provision_id IS NOT NULL THEN 'matched' ELSE 'not_found' END AS outcome
    FROM part LEFT JOIN t ON n = p_partkey % 90 + 1 AND c = p_partkey % 5""".replace("|| p_partkey % 90 + 1 ||", "|| (p_partkey % 90 + 1) ||")
)
def resolve_citation(spark: SparkSession, d: str) -> DataFrame:
    provisions = _provisions(spark, d).withColumn("path", F.regexp_replace("path", r"^ch[0-9]+\.", "")).groupBy("instrument", "path").agg(F.min("provision_id").alias("provision_id"))
    nothing = spark.createDataFrame([], "canonical_id string, doc_id long")
    return law.resolved(law.citations(_cited(spark, d), "p_partkey"), provisions, nothing, "p_partkey").select("p_partkey", "canonical_id", "entity", "outcome")


@query("SELECT p_partkey, 'r' || (p_partkey % 90 + 1) || '.' || (p_partkey % 7 + 1) || '.' || chr(CAST(97 + p_partkey % 5 AS INTEGER)) AS path FROM part")
def locators(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("clause ("), F.char(97 + F.col("p_partkey") % 5), F.lit(") of sub-rule ("), (F.col("p_partkey") % 7 + 1).cast("string"), F.lit(") of rule "), (F.col("p_partkey") % 90 + 1).cast("string"))
    return s.table(spark, d, "part").select("p_partkey", law.locator_of(text, F.lit(None).cast("string"))["path"].alias("path"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ntf:CT:' || n || '/2020' WHEN 1 THEN 'cir:' || n || '/7/2021' WHEN 2 THEN 'ins:' || n || '/2020' WHEN 3 THEN 'jdg:HC-DL:WP(C)' || n || '/2019:2020-02-01' WHEN 4 THEN NULL ELSE 'prov:CGST_ACT:s' || n END AS canonical_id,
    CASE p_partkey % 6 WHEN 0 THEN 'ntf' WHEN 1 THEN 'cir' WHEN 2 THEN 'ins' WHEN 3 THEN 'jdg' WHEN 5 THEN 'prov' END AS kind, CASE WHEN p_partkey % 6 IN (0, 2) THEN CAST(n AS VARCHAR) END AS number,
    CASE p_partkey % 6 WHEN 0 THEN '2020' WHEN 1 THEN '2021' WHEN 2 THEN '2020' END AS year, CASE WHEN p_partkey % 6 = 5 THEN 's' || n END AS path FROM (SELECT p_partkey, p_partkey % 90 + 1 AS n FROM part)"""
)
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers made of their parts (every sixth with a month of no use) and taken apart again."""

    def one(k: int, n: int) -> str | None:
        kinds = (lambda: ids.made("ntf", series="CT", number=n, year=2020), lambda: ids.made("cir", a=n, b=7, year=2021), lambda: ids.made("ins", number=n, year=2020), lambda: ids.made("jdg", court="HC-DL", case=f"wp(c) {n}/2019", decided="2020-02-01"), lambda: ids.made("jdg", court="SC", case="CA 1/2020", decided="2020-13-01"), lambda: ids.made("prov", instrument="CGST_ACT", path=f"s{n}"))
        return kinds[k]()

    made = arrow_udf(one, "string")((F.col("p_partkey") % 6).cast("int"), F.col("p_partkey") % 90 + 1)
    rows = s.table(spark, d, "part").select("p_partkey", made.alias("canonical_id"))
    return rows.withColumn("x", arrow_udf(ids.parsed, f"struct<{ids.PARTS}>")("canonical_id")).select("p_partkey", "canonical_id", "x.kind", "x.number", "x.year", "x.path")


@query("SELECT p_partkey, CAST(p_partkey % 90 + 1 AS VARCHAR) AS number, CAST(p_partkey % 9 + 1 AS VARCHAR) AS bracket, p_name AS tail FROM part")
def numbering_tokens(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat((F.col("p_partkey") % 90 + 1).cast("string"), F.lit(". ( "), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" ) "), "p_name")
    got = s.table(spark, d, "part").select("p_partkey", law.numbering_of(text).alias("x"))
    return got.select("p_partkey", *[F.col("x")[k]["value"].alias(n) for k, n in enumerate(("number", "bracket", "tail"))])


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE ['notification', 'circular', 'judgement', 'act', 'judgement'][doc_id % 6 + 1] END AS doc_type, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE ['notification', 'circular', 'judgement_hc', 'act', 'judgement_aar'][doc_id % 6 + 1] END AS cue,
    CASE WHEN doc_id % 6 = 5 THEN NULL ELSE [5, 8, 6, 2, 9][doc_id % 6 + 1] END AS authority_rank FROM documents WHERE length(trim(replace(text, chr(10), ' '), ' ')) > 0"""
)
def classify(spark: SparkSession, d: str) -> DataFrame:
    """Leads with a cue, with a later one behind it, and with words that only look like one."""
    leads = ("as in Notification No. 7/2020 and Circular No. 2", "Circular No. 2 read with Order No. 5", "IN THE HIGH COURT OF X, Notification No. 1", "THE LAND TAX ACT, 2019", "AUTHORITY FOR ADVANCE RULING", "as the Land Tax Act, 2019 says, Notification No. follows")
    lead = F.element_at(F.array(*map(F.lit, leads)), (F.col("doc_id") % 6 + 1).cast("int"))
    return law.classified(s.blocks(spark, d).withColumn("text", F.when(F.col("seq") == 0, F.concat(lead, F.lit(" "), "text")).otherwise(F.col("text"))), "doc_id")


@query(
    """WITH b AS (SELECT o_custkey AS k, o_orderkey AS seq, 'ch' || o_orderkey % 3 || '.s' || o_orderkey % 5 || CASE WHEN o_orderkey % 2 = 0 THEN '.' || o_orderkey % 4 ELSE '' END AS path FROM orders),
    own AS (SELECT k, path, min(seq) AS first_seq, string_agg(CAST(seq AS VARCHAR), chr(10) ORDER BY seq) AS text FROM b GROUP BY 1, 2),
    above AS (SELECT k, first_seq, array_to_string(p[1:unnest(range(1, len(p) + 1))], '.') AS path FROM (SELECT k, first_seq, string_split(path, '.') AS p FROM own)),
    n AS (SELECT k, path, min(first_seq) AS first_seq FROM above GROUP BY 1, 2),
    m AS (SELECT *, CASE WHEN len(string_split(path, '.')) > 1 THEN array_to_string(string_split(path, '.')[1:-2], '.') END AS parent, len(string_split(path, '.')) - 1 AS depth FROM n)
    SELECT m.k, m.path, m.first_seq, parent, depth, row_number() OVER (PARTITION BY m.k, parent ORDER BY m.first_seq, m.path) AS ordinal, text, text IS NULL AS synthesised FROM m LEFT JOIN own ON own.k = m.k AND own.path = m.path"""
)
def build_provisions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.concat(F.lit("ch"), (key % 3).cast("string"), F.lit(".s"), (key % 5).cast("string"), F.when(key % 2 == 0, F.concat(F.lit("."), (key % 4).cast("string"))).otherwise(""))
    return law.provision_tree(s.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), key.alias("seq"), path.alias("path"), key.cast("string").alias("text")), "k")


def planned_steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A baseline for each customer, and for each of its orders a rate that replaces the one before."""
    base = s.table(spark, d, "customer").select(F.col("c_custkey").alias("provision_id"), F.lit("The rate is 0 per cent.").alias("base_text"), F.lit("1995-01-01").cast("date").alias("base_from"))
    v = s.versions(spark, d)
    rate = F.row_number().over(law.Window.partitionBy("provision_id").orderBy("valid_from"))
    none = F.lit(None).cast("string")
    steps = v.withColumn("n", rate).select("provision_id", F.col("version_id").cast("string").alias("amendment_id"), F.col("valid_from").alias("effective_from"), F.lit("substitute_words").alias("kind"), (F.col("n") - 1).cast("string").alias("old_text"), F.col("n").cast("string").alias("new_text"), none.alias("anchor_text"), none.alias("position"), F.lit(None).cast("int").alias("occurrence"))
    return base, steps


#: An order on the day of the baseline is before it, so no later rate finds its words: all of that customer's later orders fail.
PLAN = f"""{VERSIONS}, seen AS (SELECT *, row_number() OVER (PARTITION BY provision_id ORDER BY valid_from) AS n, min(valid_from) OVER (PARTITION BY provision_id) > DATE '1995-01-01' AS good FROM versions),
ok AS (SELECT * FROM seen WHERE good),
planned AS (SELECT provision_id, valid_from, valid_to, 'The rate is ' || n || ' per cent.' AS text, CAST(version_id AS VARCHAR) AS amendment_id, NULL AS problem FROM ok
UNION ALL SELECT c_custkey, DATE '1995-01-01', (SELECT min(valid_from) FROM ok WHERE provision_id = c_custkey), 'The rate is 0 per cent.', NULL, NULL FROM customer
UNION ALL SELECT provision_id, NULL, NULL, NULL, CAST(version_id AS VARCHAR), CASE WHEN n = 1 THEN 'before_baseline' ELSE 'old_text_not_found' END FROM seen WHERE NOT good)"""


@query(f"WITH {PLAN} SELECT * FROM planned")
def replay_timeline(spark: SparkSession, d: str) -> DataFrame:
    return law.replayed(*planned_steps(spark, d))


ACTIVE = f"""{PLAN}, stored AS (SELECT provision_id, valid_from, valid_to, CASE WHEN provision_id % 3 = 0 THEN 'old' ELSE text END AS text, amendment_id FROM planned WHERE problem IS NULL AND provision_id % 7 <> 0)"""


def _stored(planned: DataFrame) -> DataFrame:
    """What is stored before a consolidation: of every third provision another text, of every seventh nothing."""
    return planned.where("problem is null").withColumn("text", F.when(F.col("provision_id") % 3 == 0, "old").otherwise(F.col("text"))).where("provision_id % 7 <> 0")


@query(f"WITH {PLAN} SELECT DISTINCT provision_id, CASE WHEN provision_id % 7 = 0 THEN 'insert' WHEN provision_id % 3 = 0 THEN 'replace' ELSE 'unchanged' END AS action FROM planned WHERE problem IS NULL")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    planned = cut(law.replayed(*planned_steps(spark, d)))
    return law.consolidation(_stored(planned), planned)


@query(
    f"""WITH {ACTIVE} SELECT *, DATE '2020-01-01' AS rec_from, CASE WHEN provision_id % 3 = 0 THEN DATE '2024-01-01' END AS rec_to FROM stored
    UNION ALL SELECT provision_id, valid_from, valid_to, text, amendment_id, DATE '2024-01-01', NULL FROM planned WHERE problem IS NULL AND (provision_id % 7 = 0 OR provision_id % 3 = 0)"""
)
def consolidated_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows a consolidation closes on record, leaves and adds."""
    planned = cut(law.replayed(*planned_steps(spark, d)))
    day = lambda x: F.lit(x).cast("date")
    stored = _stored(planned).drop("problem").withColumn("rec_from", day("2020-01-01")).withColumn("rec_to", F.lit(None).cast("date"))
    return law.consolidated(stored, planned, day("2024-01-01"))


@query(
    f"""WITH {PLAN} SELECT DISTINCT CAST(amendment_id AS BIGINT) % 500 AS src_id, provision_id AS dst_id, 'substitutes' AS link_type FROM planned WHERE amendment_id IS NOT NULL AND problem IS NULL AND provision_id % 4 <> 0"""
)
def amendment_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of amendments to what they changed; those of every fourth provision are there already."""
    planned = cut(law.replayed(*planned_steps(spark, d)))
    amendments = s.versions(spark, d).select(F.col("version_id").cast("string").alias("amendment_id"), (F.col("version_id") % 500).alias("doc_id"), F.lit("substitute").alias("op"))
    every = law.amendment_links(planned, amendments, spark.createDataFrame([], "src_id long, dst_id long, link_type string"))
    return law.amendment_links(planned, amendments, every.where("dst_id % 4 = 0"))


@query(
    """SELECT p_partkey AS n, CASE p_partkey % 8 WHEN 0 THEN 'Levy ' || p_partkey || ' applies, with cess.' WHEN 1 THEN 'Levy ' || p_partkey || ' applies.' WHEN 2 THEN 'Levy' || ' ' || p_partkey || ' applies.'
    WHEN 3 THEN 'Levy ' || p_partkey || ' is due.' WHEN 4 THEN NULL WHEN 5 THEN 'Levy ' || p_partkey || ' applies.' WHEN 6 THEN 'शुल्क ' || p_partkey || ' लागू है' ELSE 'Levy ' || p_partkey || ' applies.' END AS result,
    CASE p_partkey % 8 WHEN 1 THEN 'old_text_not_found' WHEN 2 THEN 'provision_exists' WHEN 5 THEN 'anchor_not_found' WHEN 7 THEN 'words_missing' END AS reason FROM part"""
)
def apply_ops(spark: SparkSession, d: str) -> DataFrame:
    """One operation of each kind on a text for each part, some of them in vain."""
    key = F.col("p_partkey").cast("string")
    kinds = ("insert_words", "omit_words", "insert_provision", "substitute_words", "omit_provision", "insert_words", "substitute_words", "substitute_words")
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 8 == 6, F.concat(F.lit("कर "), key, F.lit(" लागू है"))).otherwise(F.concat(F.lit("Levy "), key, F.lit(" applies.")))
    rows = s.table(spark, d, "part").select("p_partkey", text.alias("text"), at(kinds).alias("kind"), at((None, "Lev", None, "applies", None, None, "कर", "applies")).alias("old"), at((", with cess", None, "x", "is due", None, "x", "शुल्क", None)).alias("new"), at(("applies", None, None, None, None, "pplies", None, None)).alias("anchor"))

    def one(text: str, kind: str, old: str | None, new: str | None, anchor: str | None) -> tuple:
        return amend.applied(text, {"kind": kind, "old_text": old, "new_text": new, "anchor_text": anchor})

    got = rows.select(F.col("p_partkey").alias("n"), arrow_udf(one, "struct<result: string, reason: string>")("text", "kind", "old", "new", "anchor").alias("r"))
    return got.select("n", F.regexp_replace("r.result", " ,", ",").alias("result"), "r.reason")


def _notified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A notification for each part, with a clause of each kind; those of every fifth say another word."""
    p = s.table(spark, d, "part")
    key = F.col("p_partkey")
    rule = (key % 90 + 1).cast("string")
    quoted = lambda x: F.concat(F.lit("“"), x, F.lit("”"))
    lines = [
        F.lit("The following rules further to amend the Central Goods and Services Tax Rules, 2017, namely:-"),
        F.lit("2. In the said rules,-"),
        F.concat(F.lit("(i) in rule "), rule, F.lit(", for the words "), quoted(F.when(key % 5 == 0, "elsewhere").otherwise("a rate")), F.lit(", the words "), quoted(F.lit("the rate")), F.lit(" shall be substituted;")),
        F.concat(F.lit("(ii) after rule "), rule, F.lit(", the following rule shall be inserted, namely:-")),
        quoted(F.concat((key % 90 + 1).cast("string"), F.lit("A. New; text."))),
        F.lit("(iii) rule 200 shall be omitted with effect from the 1st May, 2021;"),
        F.lit("(iv) some things are substituted in ways of their own."),
        F.lit("3. These rules shall come into force on the 1st April, 2021."),
    ]
    blocks = p.select("p_partkey", F.posexplode(F.array(*lines)).alias("seq", "text"))
    return blocks, p.select("p_partkey", F.lit("2021-03-01").cast("date").alias("doc_date"))


NOTIFIED = """p AS (SELECT p_partkey, p_partkey % 90 + 1 AS n FROM part),
clauses AS (SELECT p_partkey, n, 0 AS place, 'substitute' AS op, 'words' AS kind, 'r' || n AS target_path, CASE WHEN p_partkey % 5 = 0 THEN 'elsewhere' ELSE 'a rate' END AS old_text, 'the rate' AS new_text, DATE '2021-04-01' AS effective_from, 0.9 AS confidence FROM p
UNION ALL SELECT p_partkey, n, 1, 'insert', 'provision', 'r' || n || 'A', NULL, n || 'A. New; text.', DATE '2021-04-01', 0.9 FROM p
UNION ALL SELECT p_partkey, n, 2, 'omit', 'provision', 'r200', NULL, NULL, DATE '2021-05-01', 0.9 FROM p
UNION ALL SELECT p_partkey, n, 3, 'amend', 'raw', NULL, NULL, NULL, DATE '2021-04-01', 0.0 FROM p)"""


@query(f"WITH {NOTIFIED} SELECT p_partkey, CAST(place AS INTEGER) AS place, op, kind, CASE WHEN kind = 'raw' THEN 'CGST_RULES' ELSE 'CGST_RULES' END AS instrument, target_path, old_text, new_text, effective_from, CAST(confidence AS DOUBLE) AS confidence FROM clauses")
def amend_detect(spark: SparkSession, d: str) -> DataFrame:
    found = amendments.proposals(*_notified(spark, d), "p_partkey")
    return found.select("p_partkey", "place", "op", "kind", "instrument", "target_path", "old_text", "new_text", "effective_from", "confidence")


@query(
    """WITH o AS (SELECT o_custkey AS k, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders), f AS (SELECT *, seq % 7 AS form, 'r' || (seq // 7 + 1) AS rule FROM o)
    SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY seq) - 1 AS INTEGER) AS place, CASE form WHEN 1 THEN 'substitute' WHEN 2 THEN 'insert' WHEN 4 THEN 'insert' WHEN 6 THEN 'amend' ELSE 'omit' END AS op,
    CASE WHEN form IN (3, 4) THEN 'provision' WHEN form = 6 THEN 'raw' ELSE 'words' END AS kind, 'CGST_RULES' AS instrument, rule || CASE form WHEN 3 THEN '.2' WHEN 4 THEN '.3A' ELSE '' END AS target_path,
    CASE WHEN form = 4 THEN rule || '.3' END AS anchor_path, CASE form WHEN 2 THEN 'before' WHEN 4 THEN 'after' END AS position, CASE WHEN form = 2 THEN 'boat' END AS anchor_text, CASE form WHEN 1 THEN 'tolls; dues' WHEN 5 THEN '5' END AS old_text,
    CASE form WHEN 1 THEN o_orderpriority WHEN 2 THEN 'long' WHEN 4 THEN '(3A) New; text' END AS new_text, CASE WHEN form = 4 THEN '3A' END AS new_label, CASE WHEN form = 3 THEN DATE '2021-05-01' ELSE DATE '2021-03-01' END AS effective_from,
    CASE WHEN form = 3 THEN 'on_date' ELSE 'on_gazette' END AS condition, CASE WHEN form = 6 THEN 'grammar_no_match' ELSE '' END AS problems, CAST(seq AS INTEGER) AS block FROM f WHERE form > 0"""
)
def amend_forms(spark: SparkSession, d: str) -> DataFrame:
    """A notification for each customer, a line for each order: leads of numbered paragraphs and clauses of every kind in them."""
    at = F.row_number().over(law.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = s.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), at.alias("seq"), "o_orderpriority")
    number = (F.floor(F.col("seq") / 7) + 1).cast("string")
    lines = [
        F.concat(number, F.lit(". In rule "), number, F.lit(" of the CGST Rules,-")), F.concat(F.lit("(a) for the words “tolls; dues”, the words “"), "o_orderpriority", F.lit("” shall be substituted;")), F.lit("(b) before the word “boat”, insert the word “long”;"),
        F.lit("(c) sub-rule (2) shall be omitted with effect from the 1st May, 2021;"), F.lit("(d) after sub-rule (3), the following sub-rule shall be inserted, namely:- “(3A) New; text”;"), F.lit("(e) omit the figures “5”; and"), F.lit("(f) in clause (z), all rows are rescinded."),
    ]
    blocks = rows.select("k", "seq", F.element_at(F.array(*lines), (F.col("seq") % 7 + 1).cast("int")).alias("text"))
    found = amendments.proposals(blocks, rows.select("k").distinct().withColumn("doc_date", F.lit("2021-03-01").cast("date")), "k")
    kept = ("k", "place", "op", "kind", "instrument", "target_path", "anchor_path", "position", "anchor_text", "old_text", "new_text", "new_label", "effective_from", "condition")
    return found.select(*kept, F.array_join("problems", ",").alias("problems"), F.col("blocks")[0].alias("block"))


@query(
    f"""WITH {NOTIFIED}, hits AS (SELECT c_custkey % 60 + 1 AS n, count(*) AS hits, min(c_custkey) AS provision_id FROM customer GROUP BY 1)
    SELECT p_partkey, CAST(place AS INTEGER) AS place, CASE WHEN kind = 'raw' OR op = 'omit' OR hits IS NULL THEN 'not_found' WHEN hits = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN kind <> 'raw' AND op <> 'omit' AND hits = 1 THEN provision_id END AS provision_id,
    kind <> 'raw' AND op <> 'omit' AND coalesce(hits = 1, false) AND NOT (op = 'substitute' AND p_partkey % 5 = 0) AS dry_run_ok, CASE WHEN op = 'substitute' AND hits = 1 AND p_partkey % 5 = 0 THEN 'old_text_not_found' END AS dry_run_reason,
    CASE WHEN kind <> 'raw' AND op <> 'omit' AND coalesce(hits = 1, false) THEN 'proposed' ELSE 'needs_info' END AS review_status FROM clauses LEFT JOIN hits USING (n)"""
)
def amend_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """The stage after detection: targets looked up, clauses tried on the text that stands, and the review they need."""
    provisions = s.table(spark, d, "customer").select(F.col("c_custkey").alias("provision_id"), F.lit("CGST_RULES").alias("instrument"), F.concat(F.lit("ch1.r"), (F.col("c_custkey") % 60 + 1).cast("string")).alias("path"))
    versions = provisions.select("provision_id", F.lit("It is a rate.").alias("text"), F.lit("2018-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    got = law.tried(amendments.proposals(*_notified(spark, d), "p_partkey"), provisions, versions, "p_partkey", F.lit("2021-04-01").cast("date"))
    return got.select("p_partkey", "place", "outcome", "provision_id", "dry_run_ok", "dry_run_reason", "review_status")


@query(
    f"""WITH {PLAN} SELECT provision_id, valid_from, 'The rate is [-' || n - 1 || '-]{{{{+' || n || '+}}}} per cent.' AS diff FROM ok"""
    .replace("{{+", "{+").replace("+}}", "+}").replace("[-' || n - 1 || '-]", "[-' || (n - 1) || '-]")
)
def word_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring versions of provisions, with words taken out and put in marked."""
    v = law.replayed(*planned_steps(spark, d)).where("problem is null")
    before = F.lag("text").over(law.Window.partitionBy("provision_id").orderBy("valid_from"))
    return v.withColumn("before", before).where("before is not null").select("provision_id", "valid_from", word_diff("before", "text").alias("diff"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h[1-6][ >]')) AS headings FROM pages")
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    found = law.html_blocks(s.table(spark, d, "pages"), "page_id").groupBy("page_id").agg(F.count(F.when(F.col("kind") == "heading", 1)).alias("headings"))
    return s.table(spark, d, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("headings", F.lit(0)).alias("headings"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return law.html_blocks(s.table(spark, d, "pages"), "page_id")


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM documents")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").select("doc_id", normalise_text("text").alias("text"))


@query(
    """SELECT o_orderkey AS k, 'CT' AS series, CAST(o_orderkey % 60 + 1 AS VARCHAR) AS number, CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%Y-%m-%d') AS doc_date,
    'ntf:CT:' || (o_orderkey % 60 + 1) || '/' || year(o_orderdate) AS canonical_id, CASE WHEN o_orderkey % 2 = 0 THEN 0.475 ELSE 0.95 END AS sure, CASE WHEN o_orderdate < DATE '2017-06-01' THEN 'crosscheck:doc_date out of range: ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ',' ELSE '' END ELSE '' END
    || CASE WHEN o_orderkey % 2 = 0 THEN 'crosscheck:number disagrees with title' ELSE '' END AS issues FROM orders"""
)
def extract_meta(spark: SparkSession, d: str) -> DataFrame:
    """Notifications whose title names another number where the order is even, dated before the tax began."""
    o = s.table(spark, d, "orders")
    key = F.col("o_orderkey")
    head = F.concat(F.lit("Notification No. "), (key % 60 + 1).cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(" - Central Tax"))
    dated = F.concat(F.lit("New Delhi, dated "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    blocks = o.select(key.alias("k"), F.posexplode(F.array(head, dated)).alias("seq", "text"))
    docs = o.select(key.alias("k"), F.lit("notification").alias("doc_type"), F.when(key % 2 == 0, "on 999/1999").otherwise("").alias("title"), F.lit(None).cast("string").alias("file_name"))
    got = fields.fields(blocks, docs, "k", F.lit("2030-01-01").cast("date"))
    return got.select("k", *[F.col("fields")[n].alias(n) for n in ("series", "number", "year", "doc_date", "canonical_id")], F.col("confidence")["number"].alias("sure"), F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'HC-DL' WHEN 1 THEN 'SC' ELSE 'AAAR' END AS court_code, CASE WHEN c_custkey % 3 = 0 THEN 'WP(C) ' || c_custkey || '/2019' ELSE 'CA ' || c_custkey || '/2019' END AS case_numbers, '2020-02-03' AS decision_date,
    c_name || ' v. State' AS title, 'B. Sen; A. Rao' AS judges FROM customer"""
)
def judgement_fields(spark: SparkSession, d: str) -> DataFrame:
    c = s.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    court = F.element_at(F.array(*map(F.lit, ("IN THE HIGH COURT OF DELHI AT NEW DELHI", "IN THE SUPREME COURT OF INDIA", "BEFORE THE APPELLATE AUTHORITY FOR ADVANCE RULING"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    case = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("W.P.(C) No. "), key, F.lit(" / 2019"))).otherwise(F.concat(F.lit("Civil Appeal No. "), key, F.lit(" of 2019")))
    lines = [court, case, F.concat("c_name", F.lit(" ..... Petitioner")), F.lit("State ..... Respondent"), F.lit("CORAM: Hon'ble Mr. Justice B. Sen and Hon'ble Ms. Justice A. Rao"), F.lit("1. The facts."), F.lit("dated 1st January, 2020 and then dated 03.02.2020")]
    blocks = c.select(F.col("c_custkey").alias("k"), F.posexplode(F.array(*lines)).alias("seq", "text"))
    docs = c.select(F.col("c_custkey").alias("k"), F.lit("judgement").alias("doc_type"), F.lit("").alias("title"), F.lit(None).cast("string").alias("file_name"))
    got = fields.fields(blocks, docs, "k", F.lit("2030-01-01").cast("date"))
    return got.select("k", *[F.col("fields")[n].alias(n) for n in ("court_code", "case_numbers", "decision_date", "title", "judges")])


@query(
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'order' ELSE 'instruction' END AS kind, o_orderkey, o_orderdate, 'Tolls of ' || o_orderpriority AS subject, year(o_orderdate) AS y FROM orders)
    SELECT k, kind AS doc_type, CASE WHEN k % 5 > 0 THEN k::VARCHAR END AS number, CASE WHEN k % 5 > 0 THEN left(kind, 3) || ':' || k || '/' || y END AS canonical_id, o_orderdate::DATE::VARCHAR AS doc_date,
    CASE WHEN k % 3 = 0 THEN 'AB' || lpad(k::VARCHAR, 18, '0') END AS din, CASE WHEN k % 7 = 0 THEN subject END AS subject,
    CASE WHEN k % 7 = 0 THEN subject WHEN k % 4 = 0 THEN 'ON THE TOLLS OF ' || k WHEN k % 5 > 0 THEN upper(left(kind, 1)) || substr(kind, 2) || ' No. ' || k ELSE 'file.pdf' END AS title,
    CASE WHEN k % 7 = 0 THEN 0.95 WHEN k % 4 = 0 OR k % 5 > 0 THEN 0.7 ELSE 0.5 END AS title_sure, CASE WHEN o_orderdate::DATE < DATE '2017-06-01' THEN 0.475 ELSE 0.95 END AS date_sure,
    concat_ws(',', CASE WHEN o_orderdate::DATE < DATE '2017-06-01' THEN 'crosscheck:doc_date out of range: ' || o_orderdate::DATE END, CASE WHEN k % 5 = 0 THEN 'missing:number,missing:year' END) AS issues FROM o"""
)
def order_fields(spark: SparkSession, d: str) -> DataFrame:
    """Orders and instructions: some without a number, a subject, an identification number or a heading, some dated before the tax."""
    o = s.table(spark, d, "orders")
    key, word = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    kind = F.when(key % 2 == 0, "order").otherwise("instruction")
    head = F.when(key % 5 > 0, F.concat(F.when(key % 2 == 0, "ORDER No. ").otherwise("Instruction  no "), word, F.lit(" / "), F.year("o_orderdate").cast("string"))).otherwise("To all officers")
    lines = [
        head,
        F.concat(F.lit("dated the "), F.date_format("o_orderdate", "d MMMM, yyyy")),
        F.when(key % 7 == 0, F.concat(F.lit("Sub : Tolls of "), "o_orderpriority")).otherwise(""),
        F.when(key % 3 == 0, F.concat(F.lit("DIN: AB"), F.lpad(word, 18, "0"), F.lit(" of record"))).otherwise(None),
        F.when(key % 4 == 0, F.concat(F.lit("ON THE TOLLS OF "), word)).otherwise("1. ALL IN CAPITALS AND YET NO TITLE"),
    ]
    blocks = o.select(key.alias("k"), F.posexplode(F.array(*lines)).alias("seq", "text"))
    docs = o.select(key.alias("k"), kind.alias("doc_type"), F.lit(None).cast("string").alias("title"), F.lit("file.pdf").alias("file_name"))
    got = fields.fields(blocks, docs, "k", F.lit("2030-01-01").cast("date"))
    sure = F.col("confidence")
    return got.select("k", "doc_type", *[F.col("fields")[n].alias(n) for n in ("number", "canonical_id", "doc_date", "din", "subject", "title")], sure["title"].alias("title_sure"), sure["doc_date"].alias("date_sure"), F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT p_partkey AS k, (p_partkey % 200) || '/' || (p_partkey % 9) || '/2020' AS number, 'cir:' || (p_partkey % 200) || '/' || (p_partkey % 9) || '/2020' AS canonical_id, p_name AS subject, p_name AS title, 'prov:CGST_ACT:s' || (p_partkey % 90 + 1) AS sections_referred FROM part"""
)
def circular_fields(spark: SparkSession, d: str) -> DataFrame:
    p = s.table(spark, d, "part")
    head = F.concat(F.lit("Circular No. "), (F.col("p_partkey") % 200).cast("string"), F.lit("/"), (F.col("p_partkey") % 9).cast("string"), F.lit("/2020"))
    lines = [head, F.lit("dated the 5th May, 2020"), F.concat(F.lit("Subject: "), "p_name"), F.concat(F.lit("2. Under section "), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit(" of the CGST Act, credit is due. Nothing else."))]
    blocks = p.select(F.col("p_partkey").alias("k"), F.posexplode(F.array(*lines)).alias("seq", "text"))
    docs = p.select(F.col("p_partkey").alias("k"), F.lit("circular").alias("doc_type"), F.lit("").alias("title"), F.lit("x.pdf").alias("file_name"))
    return fields.fields(blocks, docs, "k", F.lit("2030-01-01").cast("date")).select("k", *[F.col("fields")[n].alias(n) for n in ("number", "canonical_id", "subject", "title", "sections_referred")])


@query(
    """SELECT r_regionkey AS k, 0 AS seq, 'ch' || (r_regionkey + 1) AS path FROM region UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'ch' || (n_regionkey + 1) || '.s' || (n_nationkey + 1) || '.2' FROM nation"""
)
def segment_act(spark: SparkSession, d: str) -> DataFrame:
    """A chapter for each region and a section with a sub-section for each of its nations."""
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), F.col("r_regionkey") + 1)
    chapters = s.table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.lit(0).alias("seq"), F.concat(F.lit("CHAPTER "), roman).alias("text"))
    place = F.row_number().over(law.Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    sections = s.table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), place.alias("seq"), F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(". (2) "), "n_name").alias("text"))
    return segments.segmented(chapters.unionByName(sections).withColumn("doc_type", F.lit("act")), "k").select("k", "seq", "path")


LINES = """l AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey, o_orderkey % 4 AS kind FROM orders)"""


def _lines(spark: SparkSession, d: str, doc_type: str, texts: list, heading: int | None = None) -> DataFrame:
    """A block for each order of a customer; the order's remainder by four says what stands in it."""
    at = F.row_number().over(law.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    key = (F.col("o_orderkey") % 4).cast("int")
    return s.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(doc_type).alias("doc_type"), at.alias("seq"), F.when(key == heading, "heading").otherwise("para").alias("kind"), F.element_at(F.array(*texts), key + 1).alias("text"))


@query(
    f"""WITH {LINES}, n AS (SELECT *, max(CASE WHEN kind = 0 THEN seq END) OVER w AS para_at, max(CASE WHEN kind = 3 THEN seq END) OVER w AS sched_at, count(*) FILTER (kind = 3) OVER w AS scheds FROM l WINDOW w AS (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, max(CASE WHEN seq = para_at THEN o_orderkey % 100 END) OVER (PARTITION BY k, para_at) AS para, count(*) FILTER (kind = 1) OVER (PARTITION BY k, para_at ORDER BY seq ROWS UNBOUNDED PRECEDING) AS items FROM n)
    SELECT k, seq, CASE WHEN sched_at IS NOT NULL AND (para_at IS NULL OR sched_at > para_at) THEN 'sched' || scheds WHEN para_at IS NULL THEN 'pre' ELSE 'p' || para || CASE WHEN items > 0 THEN '.i' || items ELSE '' END END AS path FROM p"""
)
def segment_notification(spark: SparkSession, d: str) -> DataFrame:
    """Numbered paragraphs, amending units, plain lines and schedules, as the orders come."""
    number = (F.col("o_orderkey") % 100).cast("string")
    rows = _lines(spark, d, "notification", [F.concat(number, F.lit(". Paragraph")), F.lit("(i) in rule 5, a word shall be omitted"), F.lit("more of it"), F.lit("SCHEDULE of rates")])
    return segments.segmented(rows, "k").select("k", "seq", "path")


@query(
    f"""WITH {LINES}, m AS (SELECT k, seq, CASE kind WHEN 0 THEN 'p' || o_orderkey % 100 WHEN 1 THEN 'p' || o_orderkey % 100 || '.' || o_orderkey % 7 END AS marker FROM l)
    SELECT k, seq, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING), 'hdr') AS path FROM m"""
)
def segment_circular(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("o_orderkey") % 100).cast("string")
    rows = _lines(spark, d, "circular", [F.concat(number, F.lit(". Paragraph")), F.concat(number, F.lit("."), (F.col("o_orderkey") % 7).cast("string"), F.lit(" Part")), F.lit("more of it"), F.lit("and more")])
    return segments.segmented(rows, "k").select("k", "seq", "path")


@query(
    f"""WITH {LINES}, m AS (SELECT k, seq, kind, o_orderkey, last_value(CASE kind WHEN 0 THEN 'facts' WHEN 1 THEN 'order' END IGNORE NULLS) OVER w AS label FROM l WINDOW w AS (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, kind IN (2, 3) AND (kind = 3 OR label IS NOT NULL OR bool_or(kind = 3) OVER w) AS counts, label IS NULL AND NOT coalesce(bool_or(kind = 3) OVER w, false) AS header FROM m WINDOW w AS (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT *, count(*) FILTER (counts) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM c)
    SELECT k, seq, CASE WHEN header THEN 'hdr' WHEN kind IN (0, 1) THEN label WHEN kind = 3 THEN coalesce(label, 'body') || '.p' || o_orderkey % 100 ELSE coalesce(label, 'body') || '.p' || running END AS path FROM r"""
)
def segment_judgement(spark: SparkSession, d: str) -> DataFrame:
    """Headings of parts, plain paragraphs that are counted, and numbered ones."""
    number = (F.col("o_orderkey") % 100).cast("string")
    rows = _lines(spark, d, "judgement", [F.lit("FACTS OF THE CASE"), F.lit("Conclusion"), F.lit("the court says this"), F.concat(number, F.lit(". The court says"))], 1)
    return segments.segmented(rows, "k").select("k", "seq", "path")


@query("SELECT p_partkey AS k, 'r' || (p_partkey % 9 + 1) || '.2' AS path, 'p' || (p_partkey % 3 + 1) AS other FROM part")
def segment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules behind a list of contents, with a numbered table row that opens nothing, and a document of no known type."""
    p = s.table(spark, d, "part")
    number = (F.col("p_partkey") % 9 + 1).cast("string")
    lines = [F.lit("CONTENTS"), F.concat(number, F.lit(". Name")), F.lit("THE LAND RULES, 2019"), F.concat(number, F.lit(". Name")), F.lit("(2) text"), F.concat((F.col("p_partkey") % 9 + 3).cast("string"), F.lit(". | a row"))]
    blocks = p.select(F.col("p_partkey").alias("k"), F.posexplode(F.array(*lines)).alias("seq", "text"))
    rules = segments.segmented(blocks.withColumn("doc_type", F.lit("rules")), "k").where("seq = 5").select("k", "path")
    other = segments.segmented(blocks.withColumn("doc_type", F.lit("memo")), "k").where("seq = k % 3").select("k", F.col("path").alias("other"))
    return rules.join(other, "k")


FORMS = """f AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    m AS (SELECT k, seq, n, seq // 7 + 1 AS section, seq % 7 AS form FROM f)"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """An act for each customer, a line for each order: sections, clauses, provisos, numbers too far ahead, footnotes and tables, and a schedule last."""
    own = law.Window.partitionBy("o_custkey")
    at = F.row_number().over(own.orderBy("o_orderkey")) - 1
    rows = s.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("act").alias("doc_type"), at.alias("seq"), F.count("*").over(own).alias("n"), "o_orderpriority")
    section, form = F.floor(F.col("seq") / 7) + 1, F.col("seq") % 7
    numbered = F.concat(section.cast("string"), F.lit(". "), "o_orderpriority")
    lines = [numbered, F.lit("(h) long boats"), F.lit("(i) rafts"), F.lit("Provided that it rains"), F.lit("2 Inserted by Act 9 of 2018"), F.lit("Rates"), F.lit("5. | nine coins")]
    text = F.when(F.col("seq") == F.col("n") - 1, "SCHEDULE II").otherwise(F.element_at(F.array(*lines), form.cast("int") + 1))
    return rows.select("k", "doc_type", "seq", F.when(form == 5, "table").when(form == 6, "table_row").otherwise("para").alias("kind"), text.alias("text"))


@query(
    f"""WITH {FORMS} SELECT k, seq, CASE WHEN seq = n - 1 AND form <> 6 THEN 'sched1' WHEN form = 0 THEN 's' || section WHEN form = 1 THEN 's' || section || '.h' WHEN form = 2 THEN 's' || section || '.i'
    ELSE 's' || section || '.i.prov1' || CASE WHEN form = 4 THEN '.fn' || section ELSE '' END END AS path FROM m"""
)
def segment_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form of a law's block; (i) after (h) is a letter, and a row of a table has the table's path."""
    return segments.segmented(_forms(spark, d), "k").select("k", "seq", "path")


@query(f"WITH {FORMS} SELECT k, section - 1 AS seq, 's' AS prefix, CAST(section AS VARCHAR) AS label FROM m WHERE form = 0 AND seq < n - 1")
def segment_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbered items of each act, for the gate of numbers."""
    return segments.numbered_items(_forms(spark, d), "k")


@query("SELECT token, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'X' || p_partkey % 5 ELSE '9-' || p_partkey % 2 END AS token FROM part WHERE p_partkey % 2 = 0) GROUP BY 1")
def skipped_paths(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("X"), (F.col("p_partkey") % 5).cast("string"))).otherwise(F.concat(F.lit("9-"), (F.col("p_partkey") % 2).cast("string")))
    path = F.concat(F.lit("ch2.s16."), F.when(F.col("p_partkey") % 2 == 0, token).otherwise("iv"))
    return law.skipped_paths(s.table(spark, d, "part").select(path.alias("path")))


@query("SELECT p_partkey, p_partkey % 4 < 2 AS cited FROM part")
def cited_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("see S. 16 there", "under rule 3", "under rules of section", "notification 5-2020"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return s.table(spark, d, "part").select("p_partkey", law.cited(text).alias("cited"))
