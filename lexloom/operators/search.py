"""Keyword search over chunks: postings, ranking by authority, one hit a document, and group counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexemes
from .relations import all_of
from .temporal import as_on

#: Weights by authority rank and by status; document types that are worth more while recent, and how much.
AUTHORITY = {1: 1.30, 2: 1.25, 3: 1.20, 4: 1.15, 5: 1.12, 6: 1.08, 7: 1.05, 8: 1.00, 9: 0.92, 10: 0.88, 11: 0.85}
STATUS = {"rescinded": 0.5, "superseded": 0.5, "struck_down": 0.5, "stayed": 0.7, "withdrawn": 0.7}
RECENT_TYPES, RECENT_DAYS, RECENT = ("judgement", "circular", "instruction", "order"), 3 * 365, 1.05
SAME_STATE, OTHER_STATE = 1.15, 0.95
#: The groups that hits are counted in, by document type; other types are in none.
GROUPS = {"act": "provisions", "rules": "provisions", "notification": "notifications", "circular": "circulars", "instruction": "circulars", "order": "circulars", "judgement": "judgements"}
CANDIDATES = 200
#: Whole texts that a task gathers the words of.
TEXTS = 5_000


def worded(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ahead__, words__): the words of a heading (where there is one) and of the text behind it, and how many are the heading's."""
    heading = F.coalesce("heading", F.lit("")) if "heading" in docs.columns else F.lit("")
    told = lambda x: F.regexp_extract_all(F.lower(x), F.lit(lexemes.WORD), F.lit(0))
    return docs.select(*keys, F.size(told(heading)).alias("ahead__"), F.concat(told(heading), told(F.coalesce("text", F.lit("")))).alias("words__"))


def occurrences(docs: DataFrame, keys: list[str], english: bool = False) -> DataFrame:
    """(keys, term, position, weight): a row for each word of a heading (where there is one) and of the text behind it.

    English words lose their endings, and those that are not searched for have no row; their places stay empty.
    """
    rows = worded(docs, keys).select(*keys, "ahead__", F.posexplode("words__").alias("position", "term"))
    if english:
        stems = F.pandas_udf(lambda x: x.map(lexemes.stem), "string")
        rows = rows.where(~F.col("term").isin(*lexemes.STOP)).withColumn("term", stems("term"))
    return rows.select(*keys, "term", "position", F.when(F.col("position") < F.col("ahead__"), lexemes.WEIGHTS["A"]).otherwise(lexemes.WEIGHTS["B"]).alias("weight"))


def postings(docs: DataFrame, key: str, english: bool = False) -> DataFrame:
    """(term, key, tf, positions, weights): where each term stands in each text (and in its heading, where there is one).

    Built-in functions alone, but for English stems. A filter on terms reaches the words before they are shuffled.
    """
    places = F.sort_array(F.collect_list(F.struct("position", "weight")))
    rows = occurrences(docs, [key], english).groupBy("term", key).agg(places.alias("p"))
    return rows.select("term", key, F.size("p").cast("long").alias("tf"), F.col("p.position").alias("positions"), F.col("p.weight").alias("weights"))


def ranked(rows: DataFrame, keys: list[str], query: str, english: bool = False) -> DataFrame:
    """(keys, raw_rank) of postings (keys, term, positions, weights) of a query's terms: texts that fit it, with their cover-density rank."""
    wanted = lexemes.parsed(query, english)

    def rank(own: list) -> float | None:
        places = {p["term"]: p["positions"] for p in own}
        if not lexemes.matches(wanted, places):
            return None
        return lexemes.cover_density(wanted, places, {p["term"]: p["weights"] for p in own})

    gathered = rows.groupBy(*keys).agg(F.collect_list(F.struct("term", "positions", "weights")).alias("own"))  # one posting a term
    likely = F.lit(False)
    for items in wanted:  # what lacks the words of all alternatives need not be looked at
        terms = sorted({t for item in items if item.wanted for t, _ in item.terms})
        likely |= F.size(F.array_intersect("own.term", F.array(*map(F.lit, terms)))) == len(terms)
    gathered = gathered.where(likely)
    return gathered.select(*keys, F.udf(rank, "double", useArrow=True)("own").alias("raw_rank")).where("raw_rank is not null")


def found(index: DataFrame, key: str, query: str, english: bool = False) -> DataFrame:
    """(key, raw_rank): texts of an index of postings that fit a query, with their cover-density rank."""
    terms = lexemes.terms_of(lexemes.parsed(query, english))
    return ranked(index.where(F.col("term").isin(terms)), [key], query, english)


def snippets(hits: DataFrame, query: str, english: bool = False) -> DataFrame:
    """hits with a snippet of their text, the query's words marked."""
    wanted = lexemes.parsed(query, english)
    return hits.withColumn("snippet", F.udf(lambda text: lexemes.snippet(wanted, text, english=english), "string", useArrow=True)("text"))


def _equals(word: str):
    return lambda x: x == word


def matches(docs: DataFrame, key: str, query: list[str]) -> DataFrame:
    """(key, raw_rank) of texts with every term of the query: the sum of tf / (1 + ln(words)), in SQL functions alone.

    Terms are literals, so a text is looked at once and nothing is shuffled.
    """
    terms = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    wanted = sorted({t for q in query for t, _ in lexemes.words(q, False)})
    hits = [F.size(F.filter("terms__", _equals(w))) for w in wanted]
    rows = docs.withColumn("terms__", terms)
    for w in wanted:
        rows = rows.where(F.array_contains("terms__", w))
    total = sum(hits[1:], hits[0])
    return rows.withColumn("raw_rank", F.round(total / (1 + F.log(F.size("terms__").cast("double"))), 9)).drop("terms__")


def narrowed(chunks: DataFrame, on: Column, doc_types: list[str] | None = None, court_level: str | None = None, state: str | None = None, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Chunks that stand on a day, narrowed by the facets that are given."""
    return chunks.where(
        all_of(
            as_on(on, nullable_start=True),
            F.col("doc_type").isin(doc_types) if doc_types else None,
            F.col("court_level") == court_level if court_level else None,
            F.col("state_code") == state if state else None,
            F.col("valid_from") >= first if first is not None else None,
            F.col("valid_from") <= last if last is not None else None,
        )
    )


def search(index: DataFrame, chunks: DataFrame, query: str, on: Column, limit: int = 20, offset: int = 0, english: bool = True, user_state: str | None = None, **facets: object) -> tuple[DataFrame, DataFrame]:
    """(items, groups) of a query over chunks (chunk_id, doc_id, text, doc_type, authority_rank, status, valid_from, valid_to, court_level, state_code).

    The CANDIDATES best chunks by raw rank are scored, each document keeps its best one, and a page of them is given with
    snippets; groups count documents by type. Scores are rounded to four places.
    """
    hits = found(index, "chunk_id", query, english).join(narrowed(chunks, on, **facets), "chunk_id")
    best = scored(hits.orderBy(F.desc("raw_rank"), "chunk_id").limit(CANDIDATES), on, user_state)
    return page(best, query, limit, offset, english), group_counts(best)


def scored(top: DataFrame, on: Column, user_state: str | None = None) -> DataFrame:
    """Each document's best chunk of some with its score and the number of chunks."""
    score = adjusted(F.col("raw_rank"), F.col("authority_rank"), F.col("status"), F.col("doc_type"), F.col("valid_from"), on, F.col("court_level"), F.col("state_code"), F.lit(user_state).cast("string"))
    return collapsed(top.withColumn("score", F.round(score, 4)), "doc_id", "score", "chunk_id")


def page(best: DataFrame, query: str, limit: int, offset: int = 0, english: bool = True) -> DataFrame:
    """A page of documents by score, with snippets."""
    return snippets(best.orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit), query, english)


def adjusted(raw: Column, rank: Column, status: Column, doc_type: Column, valid_from: Column, on: Column, court_level: Column | None = None, state: Column | None = None, user_state: Column | None = None) -> Column:
    """A raw rank weighted by authority, jurisdiction, age and status.

    A missing or zero raw rank counts 0.1, a missing or zero authority 5. A high court's judgement weighs more in the
    user's own state and less in any other.
    """
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    unless_zero = lambda x, other: F.when(F.coalesce(x, F.lit(0)) == 0, other).otherwise(x)
    days = F.datediff(on, valid_from)
    recent = F.when(doc_type.isin(*RECENT_TYPES) & days.between(0, RECENT_DAYS), RECENT).otherwise(1.0)
    place = F.lit(1.0)
    if court_level is not None:
        same = F.coalesce(F.upper(state) == F.upper(user_state), F.lit(False))
        place = F.when((doc_type == "judgement") & (court_level == "HC"), F.when(same, SAME_STATE).otherwise(OTHER_STATE)).otherwise(1.0)
    authority = F.coalesce(F.try_element_at(table(AUTHORITY), unless_zero(rank, F.lit(5))), F.lit(1.0))
    return unless_zero(raw, F.lit(0.1)) * authority * place * recent * F.coalesce(F.try_element_at(table(STATUS), F.lower(status)), F.lit(1.0))


def collapsed(hits: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best hit of each document with the number of its hits."""
    w = Window.partitionBy(key)
    rows = hits.withColumn("passages", F.count("*").over(w)).withColumn("place__", F.row_number().over(w.orderBy(F.desc(score), F.asc(tie))))
    return rows.where("place__ = 1").drop("place__")


def group_counts(documents: DataFrame) -> DataFrame:
    """Documents by group; groups without any count 0."""
    wanted = documents.sparkSession.createDataFrame([(g,) for g in sorted(set(GROUPS.values()))], "bucket string")
    pairs = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    found = documents.withColumn("bucket", F.try_element_at(pairs, F.col("doc_type"))).groupBy("bucket").agg(F.count("*").alias("n"))
    return wanted.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def expanded(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """Queries with the expansions of the terms in them as alternatives, in the order of the terms, once each."""
    added = F.array().cast("array<string>")
    for term, more in synonyms.items():
        hit = query.rlike(r"(?i)\b" + re.escape(term) + r"\b")
        added = F.concat(added, F.when(hit, F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    told = F.array_join(F.transform(F.array_distinct(added), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ")
    return F.concat(query, F.when(told == "", "").otherwise(F.concat(F.lit(" OR ("), told, F.lit(")"))))
