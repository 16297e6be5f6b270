"""Fields of documents by type, from their blocks: a table of rules, each a format looked for in a window of blocks.

A document is its first BODY and last TAIL blocks that are not empty; longer ones are never gathered whole. Each field takes
the first rule that finds something and is as sure as that rule; what contradicts itself is half as sure and noted. Texts are
read by column expressions; only dates and citations go through the small parsers of `functions`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, legal
from ..functions.dates import EXACT, FALLBACK
from ..functions.text import normalise_text
from ..session import shares
from .folds import arrow_udf

#: How sure a field from a file's name is, and the list of provisions referred to.
FILE_NAME, REFERRED = 0.5, 0.8
#: Blocks of the head, of a judgement's head, of the body and of the tail; most provisions, longest title.
HEAD, COURT_HEAD, BODY, TAIL = 15, 30, 60, 10
MOST_SECTIONS, MOST_TITLE = 200, 300
#: The first day that a document of the tax, and one of a court, can have.
GST_START, COURT_START = "2017-06-01", "1950-01-01"
#: What each type must have.
REQUIRED = {
    "notification": ("number", "year", "series", "doc_date"), "circular": ("number", "doc_date"), "instruction": ("number", "year", "doc_date"), "order": ("number", "year", "doc_date"),
    "judgement": ("court_code", "case_numbers", "decision_date"), "act": ("title",), "rules": ("title",), "other": ("title",),
}
#: Courts by code, with their level and the names they go by in a judgement's head.
COURTS = {
    "SC": ("SC", "IN THE SUPREME COURT OF INDIA"), "HC-DL": ("HC", "HIGH COURT OF DELHI|DELHI HIGH COURT"), "HC-BM": ("HC", "HIGH COURT OF JUDICATURE AT BOMBAY|BOMBAY HIGH COURT"),
    "HC-MD": ("HC", "HIGH COURT OF JUDICATURE AT MADRAS|MADRAS HIGH COURT"), "HC-CL": ("HC", "HIGH COURT AT CALCUTTA|CALCUTTA HIGH COURT"), "HC-KA": ("HC", "HIGH COURT OF KARNATAKA|KARNATAKA HIGH COURT"),
    "HC-GJ": ("HC", "HIGH COURT OF GUJARAT|GUJARAT HIGH COURT"), "HC-AL": ("HC", "HIGH COURT OF JUDICATURE AT ALLAHABAD|ALLAHABAD HIGH COURT"),
    "HC-PH": ("HC", "HIGH COURT OF PUNJAB AND HARYANA|PUNJAB AND HARYANA HIGH COURT"), "HC-KL": ("HC", "HIGH COURT OF KERALA|KERALA HIGH COURT"),
    "HC-TG": ("HC", "HIGH COURT FOR THE STATE OF TELANGANA|TELANGANA HIGH COURT"), "GSTAT": ("GSTAT", "GOODS AND SERVICES TAX APPELLATE TRIBUNAL"),
    "AAAR": ("AAAR", "APPELLATE AUTHORITY FOR ADVANCE RULING"), "AAR": ("AAR", "AUTHORITY FOR ADVANCE RULING"),
}
#: Short forms of case numbers, and how they stand in a text.
CASES = {
    "CA": r"Civil\s+Appeal\s+No\.?\s*(\d+)\s+of\s+(\d{4})", "SLP(C)": r"SLP\s*\(C\)\s*No\.?\s*(\d+)\s+of\s+(\d{4})", "WP(C)": r"W\.?\s*P\.?\s*\(C\)\s*No\.?\s*(\d+)\s*(?:/|of)\s*(\d{4})",
    "WP": r"Writ\s+Petition\s+No\.?\s*(\d+)\s+of\s+(\d{4})", "TA": r"Tax\s+Appeal\s+No\.?\s*(\d+)\s+of\s+(\d{4})",
}
#: The rules with one format: field, types, window (head, body or file name), how sure, format, what the field is.
CIRCULARS = ("circular", "instruction", "order")
RULES = (
    ("number", ("notification",), "head", EXACT, r"(?i)Notification\s+No\.?\s*(\d{1,4})\s*/\s*(\d{4})\s*-\s*[A-Za-z]", "{1}"),
    ("number", ("notification",), "head", FALLBACK, r"(?i)(?:Notification|Notf\.?)\s+No\.?\s*(\d{1,4})\s*/\s*(\d{4})", "{1}"),
    ("number", ("notification",), "file", FILE_NAME, r"(\d{1,4})[_-](\d{4})", "{1}"),
    ("number", ("circular",), "head", EXACT, r"(?i)Circular\s+No\.?\s*(\d+)\s*/\s*(\d+)\s*/\s*(\d{4})", "{1}/{2}/{3}"),
    ("number", ("circular",), "head", FALLBACK, r"(?i)Circular\s+No\.?\s*(\d+)\s*/\s*(\d+)", "{1}/{2}"),
    ("number", ("circular",), "file", FILE_NAME, r"(?<!\d)(\d+)[_-](\d+)[_-](\d{4})", "{1}/{2}/{3}"),
    ("number", ("instruction", "order"), "head", EXACT, r"(?i)(?:Instruction|Order|Circular)\s+No\.?\s*(\d+)\s*/\s*(\d{4})", "{1}"),
    ("year", ("notification",), "head", EXACT, r"(?i)Notification\s+No\.?\s*(\d{1,4})\s*/\s*(\d{4})\s*-\s*[A-Za-z]", "{2}"),
    ("year", ("notification",), "head", FALLBACK, r"(?i)(?:Notification|Notf\.?)\s+No\.?\s*(\d{1,4})\s*/\s*(\d{4})", "{2}"),
    ("year", ("notification",), "file", FILE_NAME, r"(\d{1,4})[_-](\d{4})", "{2}"),
    ("year", ("instruction", "order"), "head", EXACT, r"(?i)(?:Instruction|Order|Circular)\s+No\.?\s*(\d+)\s*/\s*(\d{4})", "{2}"),
    ("series", ("notification",), "head", EXACT, r"(?i)Notification\s+No\.?\s*\d{1,4}\s*/\s*\d{4}\s*-\s*([A-Za-z][A-Za-z ().]*)", "{1}"),
    ("series", ("notification",), "head", FALLBACK, r"(?i)\b((?:Central|Integrated|Union Territory) Tax(?: \(Rate\))?|Compensation Cess(?: \(Rate\))?)(?![A-Za-z])", "{1}"),
    ("in_force", ("notification",), "body", EXACT, r"(?i)(?:come\s+into\s+force|effect\s+from)\s+(?:on\s+)?(?:the\s+)?(.{0,40})", "{1}"),
    ("gazette_ref", ("notification",), "body", EXACT, r"(?i)G\.?\s*S\.?\s*R\.?\s*(\d+)\s*\(\s*E\s*\)", "G.S.R. {1}(E)"),
    ("authority", ("notification",), "body", EXACT, r"(?i)Ministry\s+of\s+Finance\s*\(Department\s+of\s+Revenue\)", "Ministry of Finance (Department of Revenue)"),
    ("din", CIRCULARS, "body", EXACT, r"\bDIN\s*[:-]?\s*([0-9A-Z]{20})\b", "{1}"),
)
#: Formats of one block or of several finds: subject, numbers in a title, names of judges and of parties.
SUBJECT = r"(?i)\b(?:Subject|Sub)\s*[:-]\s*(.+?)(?=\s+(?:DIN\b|\d{1,3}\.\s)|$)"
TITLED = {"notification": r"(\d{1,4})\s*/\s*(\d{4})", "circular": r"(?<!\d)(\d+)\s*/\s*(\d+)\s*/\s*(\d{4})"}
CORAM, SIGNED = r"(?i)\bCORAM\s*:?\s*(.+)", r"([A-Z][A-Za-z. ]{2,60}?),?\s*(?:J\.|JJ\.)"
HONORIFIC = r"(?i)^(?:Hon'?ble\s+)?(?:(?:Mr|Ms|Mrs|Dr|Shri|Smt)\.?\s+)*(?:Justice\s+)?"
PARTY = r"(?im)(?:^|\G)(\.|.+?(?<!\.))\s*+\.{2,}+\s*(?:the\s+)?(petitioner|appellant|respondent|applicant)s?(?:\s*\(s\))?"
NO_TITLE, CITED = r"^\d{1,3}[.)](?=\s|$)|(?i:^(?:SCHEDULE|ANNEXURE|TABLE)\b)", r"(?i)\b(?:sections?|rules?|s\.)\s*\d"
STATUTES = {"act": r"^THE\s+[A-Z][A-Z ,-]*\s+ACT,\s*(?:19|20)\d{2}$", "rules": r"^[A-Z][A-Z ,-]*\s+RULES,\s*(?:19|20)\d{2}$"}

#: A column struct<value: string, sure: double>; the value is null where nothing was found.
Found = Column


def _day(head: str | None, body: str | None, tail: str | None) -> dict | None:
    """The date of a document: the last of its tail, else one of its head, else one anywhere; null windows are not looked at."""
    last = dates.last_dated(tail or "")
    first = None if last else dates.first_dated(head or "")
    other = None if last or first else dates.first_dated(body or "")
    day, sure = (last, EXACT) if last else first or (other and (other[0], FALLBACK)) or (None, None)
    return day and {"day": day, "sure": sure}


_day_of = arrow_udf(_day, "struct<day: date, sure: double>")
_parsed_day = arrow_udf(lambda text: dates.parse_day(text or ""), "date")
_citations = arrow_udf(legal.citations, legal.CITATION)


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _found(value: Column, sure: float | Column) -> Found:
    sure = sure if isinstance(sure, Column) else F.lit(sure)
    return F.struct(_some(value).alias("value"), sure.cast("double").alias("sure"))


def _first(*tries: Found) -> Found:
    """The first that found something; each is evaluated once."""
    return F.get(F.filter(F.array(*tries), lambda x: x["value"].isNotNull()), 0)


def _formed(text: Column, pattern: str, shape: str) -> Column:
    """The shape with the groups of a pattern's first match in it; null where it does not match."""
    parts = [F.regexp_extract(text, pattern, int(p)) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\d)\}", shape)) if k % 2 or p]
    return F.when(text.rlike(pattern), F.concat(*parts))


def _ruled(field: str, read: object = lambda x: x) -> Found:
    """A field by its rules in turn."""
    tries = [_found(read(F.when(F.col("doc_type").isin(*types), _formed(F.col(window), pattern, shape))), sure) for name, types, window, sure, pattern, shape in RULES if name == field]
    return _first(*tries)


def series_code(text: Column) -> Column:
    """The series that a spelling stands for, as `legal.series_of` finds it: the longest name in it, else the first it is part of."""
    low = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    names = [(name, code) for code, spelt in legal.SERIES.items() for name in spelt]
    inside = [F.when(low.rlike(rf"(?<!\w){re.escape(name)}(?!\w)"), code) for name, code in sorted(names, key=lambda p: -len(p[0]))]
    around = [F.when((F.length(low) > 1) & F.lit(name).contains(low), code) for name, code in names]
    return F.coalesce(*inside, *around)


def _window(blocks: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(blocks, 1, most), lambda b: b["text"]), "\n")


def _block(most: int, pattern: str) -> Column:
    """The first block that a pattern is found in."""
    return F.get(F.filter(F.slice("blocks", 1, most), lambda b: b["text"].rlike(pattern)), 0)["text"]


def _heading(most: int) -> Column:
    """The first heading, or line in capitals, of some length that is no numbered paragraph and no schedule."""
    fits = lambda b: (F.length(b["text"]) >= 10) & ~b["text"].rlike(NO_TITLE) & ((b["kind"] == "heading") | ((F.length(b["text"]) <= 120) & (b["text"] == F.upper(b["text"]))))
    return F.substring(F.get(F.filter(F.slice("blocks", 1, most), fits), 0)["text"], 1, MOST_TITLE)


def _court(text: Column) -> Column:
    """The court named first in a text; of courts at one place the first in the list."""
    places = [F.struct(F.regexp_instr(text, F.lit(f"(?i){names}")).alias("at"), F.lit(k).alias("k"), F.lit(code).alias("code"), F.lit(level).alias("level")) for k, (code, (level, names)) in enumerate(COURTS.items())]
    return F.array_min(F.filter(F.array(*places), lambda p: p["at"] > 0))


def _cases(text: Column) -> Column:
    """Case numbers in their short forms, in the order of the forms, once each."""
    def told(short: str, pattern: str) -> Column:
        numbers, years = (F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group)) for group in (1, 2))
        return F.zip_with(numbers, years, lambda n, year: F.concat(F.lit(f"{short} "), _number(n), F.lit("/"), year))

    return F.array_distinct(F.flatten(F.array(*[told(*case) for case in CASES.items()])))


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _judges(head: Column) -> Column:
    """Names after CORAM and before J., without honorifics, once each."""
    coram = F.flatten(F.transform(F.split(head, "\n"), lambda line: F.split(F.regexp_extract(line, CORAM, 1), r",|\band\b")))
    bare = lambda x: F.btrim(x, F.lit(" ,.:"))
    names = F.transform(F.concat(coram, F.regexp_extract_all(head, F.lit(SIGNED), F.lit(1))), lambda x: bare(F.regexp_replace(bare(x), HONORIFIC, "")))
    return F.array_distinct(F.filter(names, lambda x: F.length(x) >= 3))


def _side(head: Column, respondent: bool) -> Column:
    """Names before dots and a role, of one side, once each. A find begins where a line or the find before it leaves off, so long lines are read once."""
    pairs = F.arrays_zip(F.regexp_extract_all(head, F.lit(PARTY), F.lit(1)).alias("name"), F.regexp_extract_all(head, F.lit(PARTY), F.lit(2)).alias("role"))
    own = F.filter(pairs, lambda p: (F.lower(p["role"]) == "respondent") == F.lit(respondent))
    names = F.transform(own, lambda p: F.btrim(p["name"], F.lit(" ,.;:")))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def windows(blocks: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """blocks (key, seq, kind, text) as (key, blocks, tail): the first BODY and the last TAIL blocks that are not empty, in order."""
    kind = F.col("kind") if "kind" in blocks.columns else F.lit("para").alias("kind")
    said = blocks.select(key, "seq", kind, normalise_text(F.coalesce("text", F.lit(""))).alias("text"))
    said = said.repartition(tasks or shares(blocks), key).withColumn("empty", F.col("text") == "")
    names = ("seq", "kind", "text")
    ranked = said.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("empty", *names)))
    filled = F.count(F.when(~F.col("empty"), 1)).over(Window.partitionBy(key))
    ranked = ranked.withColumn("back", filled + 1 - F.col("n")).where(~F.col("empty") | (F.col("n") == 1))  # the empty ones come last; one stays for a document of no others
    kept = ranked.where(f"n <= {BODY} or back <= {TAIL}")
    ordered = lambda which: F.array_sort(F.collect_list(F.when(which & ~F.col("empty"), F.struct("n", "kind", "text"))))
    return kept.groupBy(key).agg(ordered(F.col("n") <= BODY).alias("blocks"), ordered(F.col("back") <= TAIL).alias("tail"))


def sections_referred(blocks: DataFrame, key: str) -> DataFrame:
    """(key, sections): identifiers of provisions cited in sentences that name a section or rule, once each in order, at most MOST_SECTIONS."""
    said = blocks.select(key, "seq", normalise_text(F.coalesce("text", F.lit(""))).alias("text"))
    sentences = said.select(key, "seq", F.posexplode(F.split("text", r"(?<=[.;])\s+")).alias("at", "sentence")).where(F.col("sentence").rlike(CITED))
    cited = sentences.select(key, "seq", "at", F.posexplode(_citations("sentence")).alias("place", "c")).where("c.canonical_id is not null")
    first = cited.groupBy(key, F.col("c.canonical_id").alias("id")).agg(F.min(F.struct("seq", "at", "place")).alias("first"))
    listed = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("first", "id"))).where(f"n <= {MOST_SECTIONS}")
    return listed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), "; ").alias("sections"))


def required(doc_type: Column) -> Column:
    """The names of the fields that a type must have."""
    own = reduce(lambda out, item: out.when(doc_type == item[0], F.array(*map(F.lit, item[1]))), REQUIRED.items(), F.when(F.lit(False), None))
    return own.otherwise(F.array(*map(F.lit, REQUIRED["other"])))


def least_sure(doc_type: Column, fields: Column, confidence: Column) -> Column:
    """The least confidence of the required fields; a missing one counts 0."""
    return F.array_min(F.transform(required(doc_type), lambda n: F.when(_some(fields[n]).isNotNull(), F.coalesce(confidence[n], F.lit(0.0))).otherwise(0.0)))


def _halved(found: Found, doubt: Column) -> Found:
    return F.struct(found["value"].alias("value"), F.when(doubt, found["sure"] / 2).otherwise(found["sure"]).alias("sure"))


def _least(*found: Found) -> Column:
    return F.least(*[f["sure"] for f in found])


def fields(blocks: DataFrame, documents: DataFrame, key: str, today: Column) -> DataFrame:
    """(key, doc_type, fields, confidence, issues) of documents (key, doc_type, title, file_name) that have blocks (key, seq, kind, text).

    Dates after today, or before there could be one, are doubted. Null texts count as empty; a type without rules has a
    title only.
    """
    c, kind = F.col, F.col("doc_type")
    is_a = lambda *types: F.coalesce(kind.isin(*types), F.lit(False))
    docs = documents.select(key, "doc_type", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("file_name", F.lit("")).alias("file"))
    tasks = shares(blocks)
    typed = docs.where(is_a(*[t for t in REQUIRED if t != "other"])).select(key)
    rows = windows(blocks, key, tasks).join(docs, key).join(sections_referred(blocks.repartition(tasks, key).join(typed, key, "left_semi"), key), key, "left")
    rows = rows.withColumns({"head": _window(c("blocks"), HEAD), "court_head": _window(c("blocks"), COURT_HEAD), "body": _window(c("blocks"), BODY)})

    court, dated = is_a("judgement"), is_a("notification", *CIRCULARS, "judgement")
    tail = F.array_join(F.transform("tail", lambda b: b["text"]), "\n")
    rows = rows.withColumns({
        "day": F.when(dated, _day_of(F.when(court, c("court_head")).otherwise(c("head")), "body", F.when(court, tail))),
        "in_force": _ruled("in_force"),
        "raw": _ruled("number"),
        "year": _ruled("year"),
        "series": _ruled("series", lambda x: series_code(F.regexp_replace(F.btrim(x, F.lit(" .,")), r"(?i)\s+(dated|dt\.?)$", ""))),
        "court_at_head": F.when(court, _court(c("court_head"))),
        "court_at_body": F.when(court, _court(c("body"))),
        "cases": F.when(court, _first(*[_found(F.array_join(_cases(c(w)), "; "), sure) for w, sure in (("court_head", EXACT), ("body", FALLBACK))])),
        "petitioners": F.when(court, _side(c("court_head"), False)),
        "respondents": F.when(court, _side(c("court_head"), True)),
    })
    subjects = F.filter(F.transform(F.slice("blocks", 1, 2 * HEAD), lambda b: F.when(b["text"].rlike(SUBJECT), F.trim(F.regexp_extract(b["text"], SUBJECT, 1)))), lambda x: x.isNotNull())
    named = {t: _formed(c("title"), p, "{1}/{2}" if t == "notification" else "{1}/{2}/{3}") for t, p in TITLED.items()}
    whole = c("raw.value").rlike("/.*/")
    other_title = F.when(is_a("notification"), named["notification"] != F.concat("raw.value", F.lit("/"), "year.value")).when(is_a("circular") & whole, named["circular"] != c("raw.value"))
    begun = F.when(court, F.lit(COURT_START)).otherwise(F.lit(GST_START)).cast("date")
    rows = rows.withColumns({
        "other_title": F.coalesce(other_title, F.lit(False)),
        "out_of_range": F.coalesce(~c("day.day").between(begun, today), F.lit(False)),
        "subject": F.when(is_a(*CIRCULARS), F.substring(F.get(subjects, 0), 1, MOST_TITLE)),
        "both_sides": (F.size("petitioners") > 0) & (F.size("respondents") > 0),
    })
    number = F.when(is_a("notification"), _number(c("raw.value"))).otherwise(c("raw.value"))
    rows = rows.withColumns({
        "court_code": _first(_found(c("court_at_head.code"), EXACT), _found(c("court_at_body.code"), FALLBACK)),
        "court_level": _first(_found(c("court_at_head.level"), EXACT), _found(c("court_at_body.level"), FALLBACK)),
        "number": _halved(_found(number, c("raw.sure")), c("other_title")),
        "dated": _halved(_found(c("day.day").cast("string"), c("day.sure")), c("out_of_range")),
        "made_of_dots": F.when(court, _found(F.array_join("petitioners", "; "), F.when(c("both_sides"), EXACT).otherwise(FALLBACK))),
        "answering": F.when(court, _found(F.array_join("respondents", "; "), F.when(c("both_sides"), EXACT).otherwise(FALLBACK))),
    })

    number, year, series, day = c("number"), c("year"), c("series"), c("dated")
    case = F.upper(F.regexp_replace(F.regexp_replace(F.get(F.split("cases.value", "; "), 0), r"\s+", ""), "[‐-―−]", "-"))
    name = F.when(is_a("notification"), F.concat(F.lit("ntf:"), series["value"], F.lit(":"), number["value"], F.lit("/"), year["value"]))
    name = name.when(is_a("circular") & whole, F.concat(F.lit("cir:"), number["value"])).when(is_a("instruction", "order"), F.concat(F.substring(kind, 1, 3), F.lit(":"), number["value"], F.lit("/"), year["value"]))
    name = name.when(court, F.concat(F.lit("jdg:"), c("court_code.value"), F.lit(":"), case, F.lit(":"), day["value"]))
    identified = _found(name, F.when(court, _least(c("court_code"), c("cases"), day)).otherwise(_least(number, year, series)))
    numbered = F.when(is_a("notification"), F.concat(F.lit("Notification No. "), number["value"], F.lit("/"), year["value"])).when(is_a(*CIRCULARS), F.concat(F.initcap(kind), F.lit(" No. "), number["value"]))
    statute = F.coalesce(*[F.when(kind == t, _block(HEAD, p)) for t, p in STATUTES.items()])
    sides = F.when(c("both_sides"), F.concat(F.get("petitioners", 0), F.lit(" v. "), F.get("respondents", 0)))
    title = _first(
        _found(c("subject"), EXACT), _found(statute, EXACT), _found(sides, FALLBACK), _found(F.when(court, _heading(COURT_HEAD)).otherwise(_heading(HEAD)), FALLBACK), _found(numbered, FALLBACK), _found(c("file"), FILE_NAME)
    )
    bench = _block(COURT_HEAD, r"(?i)^(?=.{1,120}$).*\bBENCH\b")
    got = {
        "number": number, "year": year, "series": series, "doc_date": F.when(~court, day), "decision_date": F.when(court, day), "in_force_date": _found(_parsed_day("in_force.value").cast("string"), EXACT),
        "gazette_ref": _ruled("gazette_ref"), "authority": _ruled("authority"), "din": _ruled("din"), "circular_kind": F.when(is_a(*CIRCULARS), _found(kind, EXACT)), "subject": _found(c("subject"), EXACT),
        "court_code": c("court_code"), "court_level": c("court_level"), "case_numbers": c("cases"), "petitioners": c("made_of_dots"), "respondents": c("answering"),
        "judges": F.when(court, _found(F.array_join(_judges(c("court_head")), "; "), FALLBACK)), "bench": F.when(court, _found(bench, FALLBACK)), "canonical_id": identified, "title": title,
        "sections_referred": _found(c("sections"), REFERRED), "doc_type": _found(kind, EXACT),
    }
    doubts = _doubts(court, day["value"], is_a("circular") & number["value"].isNotNull() & ~whole)
    rows = rows.select(key, "doc_type", doubts.alias("doubts"), *[f.alias(f"found_{name}") for name, f in got.items()])
    entries = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), c(f"found_{name}.value").alias("value"), F.round(f"found_{name}.sure", 4).alias("sure")) for name in got]), lambda x: x["value"].isNotNull())
    rows = rows.select(key, "doc_type", "doubts", entries.alias("found"))
    missing = F.transform(F.filter(required(kind), lambda n: ~F.exists("found", lambda x: x["name"] == n)), lambda n: F.concat(F.lit("missing:"), n))
    pairs = lambda value: F.map_from_entries(F.transform("found", lambda x: F.struct(x["name"], x[value])))
    return rows.select(key, "doc_type", pairs("value").alias("fields"), pairs("sure").alias("confidence"), F.array_sort(F.array_distinct(F.concat(F.array_compact("doubts"), missing))).alias("issues"))


def _doubts(court: Column, day: Column, unnumbered: Column) -> Column:
    date_name = F.when(court, "decision_date").otherwise("doc_date")
    return F.array(
        F.when(F.col("other_title"), "crosscheck:number disagrees with title"),
        F.when(F.col("out_of_range"), F.concat(F.lit("crosscheck:"), date_name, F.lit(" out of range: "), day)),
        F.when(unnumbered, "invalid_canonical: circular"),
    )
