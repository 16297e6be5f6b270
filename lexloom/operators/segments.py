"""Structure paths of blocks by type of document: each block is marked by column expressions, and marks are carried in order.

Notifications, circulars, judgements and other texts need windows only. Of laws, a small fold reads the marks of the blocks
that have some, since whether a number opens a level depends on the last one that did; lists of contents, footnotes,
schedules and rows of tables are windows there too. No document's blocks are gathered into one row.

Blocks are (key, doc_type, seq, text), with `kind` if there is one. Null texts are empty and null kinds paragraphs; a block
without a key belongs to no document and is left out; blocks of one seq stand in order of kind and text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import legal
from ..functions.text import normalise_text
from .folds import arrow_udf, folded

#: How many numbers may be left out between two sections, and between two brackets.
JUMPS = {"number": 25, "digit": 10}
#: The longest footnote, heading of a schedule, heading of a part of a judgement, and other short line.
FOOTNOTE, SCHEDULE, PART, SHORT = 300, 80, 40, 60
#: Letters before i, v and x, which are letters there; the roman numerals that brackets hold.
BEFORE = {"i": "h", "v": "u", "x": "w"}
NUMERALS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
#: Words of judgements' headings and the part each begins.
PARTS = {
    "facts": "facts", "issues": "issues", "arguments": "arguments", "submissions": "arguments", "findings": "findings", "analysis": "findings",
    "discussion": "findings", "conclusion": "order", "order": "order",
}
#: Words of footnotes, what was done and by what; openings and verbs of amending units; headings.
DONE = ("added", "amended", "inserted", "omitted", "renumbered", "repealed", "substituted", r"ins\.", r"subs\.")
SOURCES = ("w.e.f", "vide", "by Act", "by the Act", "by Finance", "by the Finance", "by Notf", "by the Notf", "by Notification", "by the Notification", "by Taxation", "by the Taxation")
AMENDED = ("inserted", "omitted", "substituted")
WITHIN = ("clause", "paragraph", "rule", "section", "sub-section", "the notification", "the said")
LISTS = ("annexure", "schedule", "table")
CONTENTS = ("arrangement of rules", "arrangement of sections", "contents", "table of contents")
#: Documents whose paths are those of laws, with the letter of their numbers; and those read as circulars.
LAWS = {"act": "s", "rules": "r"}
CIRCULARS = ("circular", "instruction", "order")

#: A number that begins a paragraph, and one of a paragraph's part.
PARAGRAPH, SUB_PARAGRAPH = r"^(\d{1,3})[.)](?:\s|$)", r"^(\d{1,3}\.\d{1,3})(?:\s|$)"

marks_of = arrow_udf(lambda text: [m for m in legal.numbering(text or "") if m["kind"] != "tail"], "array<struct<kind: string, value: string>>")


def _words(words: Iterable[str]) -> str:
    """A pattern for any of some words or phrases, whatever the spaces in them."""
    return "(?:" + "|".join(w.replace("w.e.f", r"w\.e\.f").replace(" ", r"\s+") for w in words) + ")"


def _found(text: Column, pattern: str) -> Column:
    """What the pattern's group holds, null where it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _short(kind: Column, text: Column) -> Column:
    return (kind == "heading") | (F.length(text) <= SHORT)


def is_footnote(text: Column) -> Column:
    """A line of a footnote's length that begins with a number and says what was done, and by what."""
    told = text.rlike(rf"(?i)\b{_words(SOURCES)}\b") | text.rlike(r"(?i)\bact\s+\d+\s+of\s+\d{4}\b") | text.rlike(r"(?i)\bno\.\s*\d+\s*/\s*\d{4}\b")
    plain = [w for w in DONE if not w.endswith(".")]
    dotted = [w for w in DONE if w.endswith(".")]
    done = text.rlike(rf"(?i){_words(plain)}\b") | text.rlike(rf"(?i)\b{_words(dotted)}")
    return (F.length(text) <= FOOTNOTE) & text.rlike(r"^\d{1,3}\s*\.?\s*\S") & done & told


# ---------------------------------------------------------------- windows


def _placed(blocks: DataFrame, key: str, doc_type: str) -> DataFrame:
    """The blocks that have a key, with their place in the document."""
    kind = F.coalesce("kind", F.lit("para")) if "kind" in blocks.columns else F.lit("para")
    rows = blocks.where(F.col(key).isNotNull()).select(key, F.col(doc_type).alias("doc_type"), "seq", kind.alias("kind"), "text")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("seq", "kind", "text")) - 1)


def _so_far(key: str, *parts: str) -> Window:
    return Window.partitionBy(key, *parts).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _last(mark: Column, over: Window) -> Column:
    return F.last(mark, ignorenulls=True).over(over)


def _count(flag: Column, over: Window) -> Column:
    return F.coalesce(F.sum(F.coalesce(flag, F.lit(False)).cast("long")).over(over), F.lit(0))


def _notification(rows: DataFrame, key: str) -> DataFrame:
    """pre; p<n>, and p<n>.i<m> for its amending units; sched<k>, and sched<k>.row<r> for its rows."""
    kind, said, now = F.col("kind"), F.col("said"), _so_far(key)
    number = _found(said, PARAGRAPH)
    heading = (F.length(said) <= SCHEDULE) & ((kind == "heading") | said.rlike(rf"^(?:{'|'.join(f'{w.title()}|{w.upper()}' for w in LISTS)})\b"))
    unit = said.rlike(rf"(?i)^(?:\(\s*(?:[a-z]{{1,4}}|\d{{1,3}})\s*\)|in\s+{_words(WITHIN)}\b)") & said.rlike(rf"(?i)\b{_words(AMENDED)}\b")
    mark = F.when(kind == "table_row", "row").when(number.isNotNull(), "para").when(heading, "sched").when(unit, "unit")
    rows = rows.withColumn("mark", mark).withColumn("label", F.when(F.col("mark") == "para", number))
    zone = F.when(F.col("mark") == "para", "p").when(F.col("mark").isin("sched", "row"), "s")
    rows = rows.withColumn("zone", _last(zone, now)).withColumn("before", F.lag("zone").over(Window.partitionBy(key).orderBy("place")))
    opens = (F.col("mark") == "sched") | ((F.col("mark") == "row") & ~F.col("before").eqNullSafe("s"))
    rows = rows.withColumn("scheds", _count(opens, now)).withColumn("paras", _count(F.col("mark") == "para", now)).withColumn("para", _last(F.col("label"), now))
    units = _count((F.col("mark") == "unit") & (F.col("zone") == "p"), _so_far(key, "paras"))
    lines = _count(F.col("mark") == "row", _so_far(key, "scheds"))
    rows = rows.withColumn("units", units).withColumn("lines", lines)
    in_list = F.concat(F.lit("sched"), "scheds", F.when(F.col("mark") == "row", F.concat(F.lit(".row"), "lines")).otherwise(""))
    in_para = F.concat(F.lit("p"), "para", F.when(F.col("units") > 0, F.concat(F.lit(".i"), "units")).otherwise(""))
    return rows.withColumn("path", F.when(F.col("zone") == "s", in_list).when(F.col("zone") == "p", in_para).otherwise("pre"))


def _circular(rows: DataFrame, key: str) -> DataFrame:
    """hdr until the first number, then p<n> and p<n>.<m>."""
    rows = rows.withColumn("label", F.coalesce(_found(F.col("said"), SUB_PARAGRAPH), _found(F.col("said"), PARAGRAPH)))
    return rows.withColumn("path", F.coalesce(F.concat(F.lit("p"), _last(F.col("label"), _so_far(key))), F.lit("hdr")))


def _judgement(rows: DataFrame, key: str) -> DataFrame:
    """hdr until the first number or heading of a part; then the part (body before any), and its paragraphs by their own or a running number."""
    said, now = F.col("said"), _so_far(key)
    heading = (F.col("kind") == "heading") | ((F.length(said) <= SHORT) & (said == F.upper(said)) & said.rlike("[A-Z]"))
    word = F.lower(_found(said, rf"(?i)\b({'|'.join(PARTS)})\b"))
    part = F.when(heading & (F.length(said) <= PART), F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])[word])
    rows = rows.withColumn("heading", heading).withColumn("part", part).withColumn("label", F.when(~heading, _found(said, PARAGRAPH)))
    rows = rows.withColumn("begun", F.max(F.col("part").isNotNull() | F.col("label").isNotNull()).over(now)).withColumn("within", F.coalesce(_last(F.col("part"), now), F.lit("body")))
    number = F.coalesce("label", _count(~F.col("heading") & F.col("begun"), now).cast("string"))
    return rows.withColumn("path", F.when(~F.col("begun"), "hdr").when(F.col("heading"), F.col("within")).otherwise(F.concat("within", F.lit(".p"), number)))


def _other(rows: DataFrame) -> DataFrame:
    """Every block is a paragraph of its own."""
    return rows.withColumn("label", F.lit(None).cast("string")).withColumn("path", F.concat(F.lit("p"), F.col("place") + 1))


# ---------------------------------------------------------------- laws

RUNGS = ("chapter", "number", "digit", "letter", "roman")
_OPENED = "place int, path string, labels array<string>"


def _rung(mark: dict, ladder: dict[str, str]) -> str:
    """The level a mark is of. Roman brackets below a letter are roman, but for the letter that comes next."""
    value = mark["value"]
    if mark["kind"] != "paren":
        return mark["kind"]
    if value[0].isdigit():
        return "digit"
    next_letter = "roman" not in ladder and BEFORE.get(value) == ladder.get("letter")
    return "roman" if value in NUMERALS and ladder.keys() & {"letter", "roman"} and not next_letter else "letter"


def _rank(rung: str, label: str) -> tuple:
    if rung in JUMPS:
        digits = re.match(r"\d+", label)[0]
        return int(digits), label[len(digits) :]
    return (len(label), label) if rung == "letter" else (legal.roman(label) or 0,)


def _fits(rung: str, label: str, last: str | None) -> bool:
    """Whether a label may follow the last one of its level: it is later, and by no more than the level's jump."""
    if last is None:
        return True
    old, new = _rank(rung, last), _rank(rung, label)
    return old < new and (rung not in JUMPS or new[0] - old[0] <= JUMPS[rung])


def _climbed(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
    """The paths that a law's marks open, block by block: rows (key, place, letter, short, marks) in order.

    A block's marks count up to the first that cannot come next. Sections count through the document, brackets within what
    is above them; provisos and explanations within their path; forms and annexes stand outside the sections.
    """
    ladder: dict[str, str] = {}
    section, path = None, "pre"
    counts: Counter[str] = Counter()
    for _, place, letter, short, marks in rows:
        labels, opened = [], False
        for mark in marks:
            kind, value = mark["kind"], mark["value"]
            if kind in ("proviso", "explanation", "form", "annex"):
                if kind == "form" and not short:
                    break
                apart = kind in ("form", "annex")
                ladder = {} if apart else ladder
                name = kind if apart else f"{_path(ladder)}.{kind[:4]}"
                counts[name] += 1
                path = f"{name}{counts[name]}"
            elif kind == "schedule":
                break
            else:
                rung = _rung(mark, ladder)
                if rung == "chapter":
                    number = legal.roman(re.match("[IVXLC]+", value)[0])
                    token = number and f"ch{number}"
                else:
                    last = section if rung == "number" else ladder.get(rung)
                    token = value if not (rung == "number" and value[0] == "0") and _fits(rung, value, last) else None
                if token is None:
                    break
                if rung == "number":
                    section, token = value, f"{letter}{value}"
                    labels.append(value)
                ladder = {r: ladder[r] for r in RUNGS[: RUNGS.index(rung)] if r in ladder} | {rung: token}
                path = _path(ladder)
            opened = True
        if opened:
            yield *key, place, path, labels


def _path(ladder: dict[str, str]) -> str:
    return ".".join(ladder.values()) or "pre"


def _contents(rows: DataFrame, key: str) -> DataFrame:
    """Rows with `front`: toc and pre up to the end of a list of contents, null behind it and where there is none.

    The list begins at its heading and ends at the first chapter or number that one in it has already; the last line of a
    law's title before that end begins the preamble.
    """
    now, whole = _so_far(key), Window.partitionBy(key)
    said, first = F.col("said"), F.get("marks", F.lit(0))
    begins = (F.length(said) <= SHORT) & said.rlike(rf"(?i)^{_words(CONTENTS)}\b")
    rows = rows.withColumn("toc_at", F.min(F.when(begins, F.col("place"))).over(now))
    entry = F.when((F.col("place") > F.col("toc_at")) & first["kind"].isin("chapter", "number"), F.concat(first["kind"], F.lit(" "), first["value"]))
    rows = rows.withColumn("entry", entry)
    again = F.col("entry").isNotNull() & (F.row_number().over(Window.partitionBy(key, "entry").orderBy("place")) > 1)
    rows = rows.withColumn("again", again).withColumn("end_at", F.min(F.when(F.col("again"), F.col("place"))).over(whole))
    title = (said == F.upper(said)) & said.rlike(r"^THE\b.{3,120}\b(?:ACT|RULES)\b") & said.rlike(r"\d{4}\W*$")
    inside = (F.col("place") > F.col("toc_at")) & (F.col("place") < F.col("end_at"))
    rows = rows.withColumn("title_at", F.max(F.when(inside & title, F.col("place"))).over(whole))
    listed = (F.col("place") >= F.col("toc_at")) & (F.col("place") < F.coalesce("title_at", "end_at"))
    return rows.withColumn("front", F.when(F.col("place") < F.col("end_at"), F.when(listed, "toc").otherwise("pre")))


def _law(rows: DataFrame, key: str) -> DataFrame:
    """pre and toc; ch<n>, s<n> or r<n> and brackets below; prov, expl, form, annex and sched, counted; fn<n> behind the path of a footnote."""
    kind, said, now = F.col("kind"), F.col("said"), _so_far(key)
    rows = _contents(rows.withColumn("marks", marks_of("text")), key)
    body = F.col("front").isNull()
    before = F.lag(F.when(body, kind)).over(Window.partitionBy(key).orderBy("place"))
    rows = rows.withColumn("row", body & (kind == "table_row") & F.coalesce(before.isin("table", "table_row"), F.lit(False)))
    rows = rows.withColumn("own", body & ~F.col("row"))
    rows = rows.withColumn("scheds", _count(F.col("own") & _short(kind, said) & said.rlike(r"(?i)^(?:the\s+)?schedule\s+[ivxlc]+\b"), now))
    rows = rows.withColumn("note", F.col("own") & (F.col("scheds") == 0) & is_footnote(said)).withColumn("notes", _count(F.col("note"), now))
    letter = F.when(F.col("doc_type") == "rules", LAWS["rules"]).otherwise(LAWS["act"])
    listed = said.rlike(r"^\d{1,3}[A-Z]{0,2}\.\s*\|")
    marked = rows.where(F.expr("own and scheds = 0 and not note and size(marks) > 0") & ~listed).select(key, "place", letter.alias("letter"), _short(kind, said).alias("short"), "marks")
    opened = folded(marked, [key], ["place"], _climbed, f"{marked.schema[key].name} {marked.schema[key].dataType.simpleString()}, {_OPENED}")
    rows = rows.join(opened, [key, "place"], "left")
    rows = rows.withColumn("path", F.coalesce(_last(F.col("path"), now), F.lit("pre")))
    told = F.when(F.col("scheds") > 0, F.concat(F.lit("sched"), "scheds")).when(F.col("note"), F.concat("path", F.lit(".fn"), "notes")).otherwise(F.col("path"))
    return rows.withColumn("path", F.coalesce("front", _last(F.when(F.col("own"), told), now)))


# ---------------------------------------------------------------- all types


def _segmented(blocks: DataFrame, key: str, doc_type: str) -> DataFrame:
    """The blocks of every type with their path, the prefix of numbered items and the labels of those a block has."""
    rows = _placed(blocks, key, doc_type)
    kept = [key, "doc_type", "seq", "place", "kind", "text", "path"]
    laws = rows.where(F.col("doc_type").isin(*LAWS)).withColumn("said", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    prefix = F.when(F.col("doc_type") == "rules", LAWS["rules"]).otherwise(LAWS["act"])
    out = _law(laws, key).select(*kept, prefix.alias("prefix"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    known = (*LAWS, "notification", *CIRCULARS, "judgement")
    plain = rows.withColumn("said", F.coalesce(normalise_text("text"), F.lit("")))
    kinds = F.coalesce("doc_type", F.lit("other"))
    for some, read in (
        (kinds == "notification", lambda r: _notification(r, key)),
        (kinds.isin(*CIRCULARS), lambda r: _circular(r, key)),
        (kinds == "judgement", lambda r: _judgement(r, key)),
        (~kinds.isin(*known), _other),
    ):
        out = out.unionByName(read(plain.where(some)).select(*kept, F.lit("p").alias("prefix"), F.filter(F.array("label"), F.isnotnull).alias("labels")))
    return out


def segmented(blocks: DataFrame, key: str, doc_type: str = "doc_type") -> DataFrame:
    """blocks (key, doc_type, seq, kind, text) with the structure path of each."""
    return _segmented(blocks, key, doc_type).select(key, F.col("doc_type").alias(doc_type), "seq", "kind", "text", "path")


def numbered_items(blocks: DataFrame, key: str, doc_type: str = "doc_type") -> DataFrame:
    """(key, seq, prefix, label): the numbered items of each document, counted from 0 in order, for the numbering gate."""
    rows = _segmented(blocks, key, doc_type).where(F.size("labels") > 0).select(key, "place", "prefix", F.posexplode("labels").alias("nth", "label"))
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("place", "nth")) - 1).alias("seq"), "prefix", "label")
