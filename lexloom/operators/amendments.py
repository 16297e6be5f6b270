"""Amending clauses of notifications: units cut by windows, read by a table of phrases, placed by a fold over their leads.

1. Units: blocks are cut at semicolons and ends of lines outside double quotes, which may go on through blocks; a line that
   opens a quote goes on. A unit is gathered, a document never is.
2. Phrases: a unit with its quotes numbered is held against PHRASES by column expressions.
3. Scope: "In the said rules, in rule 10,-" puts the units after it into that place, until a lead or numbered paragraph
   leaves it. A fold reads the leads and places of units in order; it sees no other text.

A unit that has an amending verb but none of the phrases is `raw`. Null texts are empty; a block without a key belongs to no
document and is left out; blocks of one seq stand in order of their text; a quote that never closes ends with the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, legal
from ..functions.legal import Place, place_of
from ..session import shares
from .folds import arrow_udf, folded

#: How sure a clause without problems is, and one with some.
CLEAR, DOUBTFUL = 0.9, 0.5
#: What quotes may hold, by the nouns they come with; the provisions that come and go; verbs that amend.
NOUNS = ("bracket", "comma", "expression", "figure", "letter", "number", "numeral", "sign", "symbol", "word")
PROVISIONS = ("clause", "explanation", "item", "paragraph", "proviso", "rule", "section")
VERBS = ("inserted", "omitted", "renumbered", "rescinded", "substituted", "in supersession")
#: The phrases of clauses: operation, what it is done to, and the words. Quotes are A and B: <A> may have nouns
#: before it, {A} must, [A] has none; commas and spaces beside them may be missing. LOC is a place, PART the provision that
#: follows, POS after or before, (the) a word that may be missing.
PHRASES = (
    ("substitute", "words", "for (the) <A>, the <B> shall be substituted"),
    ("substitute", "words", "for (the) <A>, substitute (the) <B>"),
    ("substitute", "words", "for (the) <A>, read (the) <B>"),
    ("insert", "words", "POS (the) <A>, the <B> shall be inserted"),
    ("insert", "words", "POS (the) <A>, insert (the) <B>"),
    ("insert", "provision", "after LOC, the following PART shall be inserted, [A]"),
    ("substitute", "provision", "for LOC, the following PART shall be substituted, [A]"),
    ("substitute", "provision", "for LOC, the following shall be substituted, [A]"),
    ("omit", "words", "the {A} shall be omitted"),
    ("omit", "words", "omit (the) {A}"),
    ("omit", "provision", "LOC shall be omitted"),
    ("omit", "provision", "omit LOC"),
)

_NOUN = rf"(?:{'|'.join(NOUNS)})s?"
_NOUNS = rf"{_NOUN}(?: and {_NOUN})* ?"
_SLOTS = {"LOC": r"([^,§]+?)", "POS": r"(after|before)", "PART": rf"((?:sub[\s-]?)?(?:{'|'.join(PROVISIONS)})s?)"}
_GAP = " ,-–—―:"


def _pattern(words: str) -> tuple[str, list[str]]:
    """A phrase as a pattern for a whole unit, with the leads before it, and its slots in order of their groups."""
    loose = {None: "", " ": " ?", ", ": ",? ?"}
    nouns = {"<": f"(?:{_NOUNS})?", "{": _NOUNS, "[": ""}
    slots = re.findall(r"\b[AB]\b|LOC|PART|POS", words)
    said = words.replace("(the) ", "(?:the )?")
    said = re.sub(r"(, | )?([<{[])[AB][]}>](, | )?", lambda m: loose[m[1]] + nouns[m[2]] + r"§(\d+)§" + loose[m[3]], said)
    said = re.sub("LOC|PART|POS", lambda m: _SLOTS[m[0]], said.replace("LOC, ", "LOC, ?"))
    return rf"(?i)^((?:in [^,§]+, ?)*+){said}$", ["leads", *slots]


def _form(shaped: Column) -> Column:
    """The first phrase that a unit has: its place in PHRASES, null if none."""
    return reduce(lambda out, k: out.when(shaped.rlike(_pattern(PHRASES[k][2])[0]), k), range(1, len(PHRASES)), F.when(shaped.rlike(_pattern(PHRASES[0][2])[0]), 0))


def _told(values: list) -> Column:
    """What a table with a row for each phrase says of a unit's form."""
    return F.get(F.array(*map(F.lit, values)), F.col("form"))


def _slot(name: str) -> Column:
    """What stands in a slot of a unit's form; null where the form has no such slot or nothing is there.

    Each phrase has its own branch: a pattern that changes from row to row would be compiled for each row.
    """
    has = [(k, *_pattern(words)) for k, (_, _, words) in enumerate(PHRASES)]
    branches = [(F.col("form") == k, F.nullif(F.regexp_extract("s", pattern, slots.index(name) + 1), F.lit(""))) for k, pattern, slots in has if name in slots]
    return reduce(lambda out, b: out.when(*b), branches[1:], F.when(*branches[0]))


# ---------------------------------------------------------------- units


def units(blocks: DataFrame, key: str) -> DataFrame:
    """(key, unit, raw, shaped, strings, blocks): the units of each document's blocks (key, seq, text) in order.

    raw is a unit as it stands, with plain quotes; shaped has a number between § for each quote, strings the quotes; blocks
    are the places of its blocks, from 0.
    """
    quotes = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""), "“”„«»‘’§", "\"\"\"\"\"''$")
    rows = blocks.where(F.col(key).isNotNull()).select(key, "seq", quotes.alias("text"))
    order = Window.partitionBy(key).orderBy("seq", "text")  # the one order of all windows over blocks, so they are sorted once
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    rows = rows.withColumn("count", count).select(key, "text", "count", (F.row_number().over(order) - 1).alias("place"), (F.sum("count").over(upto) - F.col("count")).alias("ahead"), F.sum("count").over(Window.partitionBy(key)).alias("total"))
    pieces = rows.select(key, "place", "ahead", "total", "count", F.col("text").startswith('"').alias("goes_on"), F.posexplode(F.split("text", '"')).alias("n", "piece"))
    pieces = pieces.withColumn("quote", F.col("ahead") + F.col("n")).withColumn("inside", F.col("quote") % 2 == 1)
    # the line ends before a quote do not cut
    cut = F.when(F.col("inside"), F.array("piece")).when(F.col("n") < F.col("count"), F.split("piece", r";|\n(?!\s*\z)")).otherwise(F.split("piece", r"[;\n]"))
    parts = pieces.select(key, "place", "total", "goes_on", "n", "quote", "inside", F.posexplode(cut).alias("m", "part"))
    begins = (F.col("m") > 0) | ((F.col("n") == 0) & ~F.col("inside") & ~F.col("goes_on"))
    parts = parts.withColumn("begins", begins).withColumn("unit", F.sum(F.col("begins").cast("long")).over(Window.partitionBy(key).orderBy("place", "n", "m")))
    joint = F.when((F.col("m") == 0) & (F.col("n") > 0), '"').when((F.col("n") == 0) & ~F.col("begins") & (F.col("place") > 0), "\n").otherwise("")
    whole = F.struct("place", "n", "m", F.col("quote").alias("q"), "inside", (F.col("total") > F.col("quote")).alias("closed"), joint.alias("joint"), "part")
    rows = parts.groupBy(key, "unit").agg(F.array_sort(F.collect_list(whole)).alias("p"))
    rows = rows.withColumn("qs", F.array_distinct(F.transform(F.filter("p", lambda x: x["inside"] & x["closed"]), lambda x: x["q"])))
    raw = F.array_join(F.transform("p", lambda x: F.concat(x["joint"], x["part"])), "")
    bare = lambda x: F.when(x["joint"] == '"', "").otherwise(x["joint"])
    number = lambda x: F.when(x["n"] > 0, F.concat(F.lit("§"), F.array_position("qs", x["q"]) - 1, F.lit("§"))).otherwise("")
    shaped = F.array_join(F.transform("p", lambda x: F.when(x["inside"] & x["closed"], number(x)).when(x["inside"], F.concat(x["joint"], x["part"])).otherwise(F.concat(bare(x), x["part"]))), "")
    of = lambda q: F.array_join(F.transform(F.filter("p", lambda x: x["q"] == q), lambda x: F.concat(bare(x), x["part"])), "")
    own = F.array_distinct(F.transform(F.filter("p", lambda x: (F.trim(x["part"]) != "") | (x["joint"] == '"')), lambda x: x["place"]))
    return rows.select(key, "unit", raw.alias("raw"), shaped.alias("shaped"), F.transform("qs", of).alias("strings"), own.alias("blocks")).where(F.col("raw").rlike(r"\S"))


# ---------------------------------------------------------------- reading

_MARKER = r"^\s*+(?:(?:\d{1,3}[A-Z]?\.|\(\s*(?:[a-z]{1,4}|\d{1,3}[A-Z]?)\s*\))\s*+)++"
day_of = arrow_udf(lambda text: text and dates.parse_day(text), "date")


def _read(rows: DataFrame) -> DataFrame:
    """Units with body, effect of their own, lead and form (null where they have none)."""
    gap = f"[{_GAP.replace('-', '')}-]"
    body = F.regexp_replace(F.regexp_replace("raw", _MARKER, ""), r"^\s+|(?<!\s)\s++$", "")
    shaped = F.regexp_replace(F.regexp_replace("shaped", _MARKER, ""), r"(?i)\(\s*hereinafter[^)]*\)", "")
    shaped = F.trim(F.regexp_replace(F.regexp_replace(shaped, r"\s+", " "), r"\b(Act|Rules) ?, ?(\d{4})\b", "$1 $2"))
    rows = rows.withColumn("numbered", F.col("raw").rlike(r"^\s*\d{1,3}\.")).withColumn("body", body).withColumn("s", shaped)
    lead = F.regexp_extract(F.rtrim("s", F.lit(_GAP)), r"(?i)^in ([^§]+)$", 1)
    rows = rows.withColumn("lead", F.when(~F.col("s").rlike(r"(?i)\b(?:for|after|before|omit|insert|substitut)"), F.nullif(lead, F.lit(""))))
    tail = r"(?i)(?<![ ,])[ ,]*+\b(?:with effect from|w\.e\.f\.?) ([^§]*)$"
    rows = rows.withColumn("day", day_of(F.nullif(F.regexp_extract("s", tail, 1), F.lit("")))).withColumn("told", F.when(F.col("day").isNotNull(), F.trim(F.regexp_extract("s", tail, 0), F.lit(" ,"))))
    s = F.when(F.col("day").isNotNull(), F.regexp_replace("s", tail, "")).otherwise(F.col("s"))
    s = F.regexp_replace(s, rf"(?i)(?<![ ,])[ ,]*+\bnamely\b{gap}*+(?=§)", " ")
    s = F.regexp_replace(s, rf"(?<!{gap}){gap}++(?=§\d+§\s*$)", " ")
    s = F.rtrim(F.regexp_replace(F.rtrim(s, F.lit(" ;,.")), r"(?i)[ ;,.](?:and|or)$", ""), F.lit(" ;,."))
    rows = rows.withColumn("s", s).withColumn("form", _form(F.col("s")))
    slots = {"leads": "leads", "a": "A", "b": "B", "loc": "LOC", "part": "PART", "position": "POS"}
    return rows.withColumns({"does": _told([op for op, _, _ in PHRASES]), "to": _told([kind for _, kind, _ in PHRASES])} | {name: _slot(slot) for name, slot in slots.items()})


# ---------------------------------------------------------------- scope


def _said(phrase: str) -> str | None:
    """said_act or said_rules, which stand for the instrument named first in the document."""
    m = re.search(r"\bsaid\s+(act|rule)", phrase, re.IGNORECASE)
    return m and {"act": "said_act", "rule": "said_rules"}[m[1].lower()]


def _entered(phrases: list[str], instrument: str | None, place: Place | None) -> tuple[str | None, Place | None] | None:
    """The scope that phrases ("the said rules", "rule 10") open one inside the other; None if one is not understood."""
    for phrase in phrases:
        inner, name = place_of(phrase), next(iter(legal.named_instruments(phrase)), None) or _said(phrase)
        if inner is None and name is None:
            return None
        instrument, place = (name, None) if inner is None else (inner.instrument or instrument, inner.within(place))
    return instrument, place


def _beside(anchor: Place, part: str, label: str | None) -> str | None:
    """The path of a provision that goes beside an anchor: a rule or section by its own number, else with the anchor's parents."""
    path = anchor.path
    if path is None or label is None:
        return None
    if (name := part.lower().rstrip("s")) in ("rule", "section"):
        return name[0] + label
    parents, _, last = path.rpartition(".")
    return f"{parents}.{label}" if parents else None


def _scoped(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Units (key, unit, numbered, lead, inner, loc, part, label, does, cue, told...) in order; of those that amend, perhaps, (key, unit, read, instrument, target_path, anchor_path, told...)."""
    instrument: str | None = None
    place: Place | None = None
    for _, unit, numbered, lead, inner, loc, part, label, does, cue, *told in rows:
        if numbered:
            place = None
        if lead and (opened := _entered(lead, instrument, place)):
            instrument, place = opened
            continue
        here = _entered(inner or [], instrument, place) if does else None
        own = place_of(loc) if loc else None
        if here is None or (loc and own is None):
            if cue:
                yield *key, unit, False, instrument, place and place.path, None, *told
            continue
        target = own.within(here[1]) if own else here[1]
        named = (own and target.instrument) or here[0]
        path = target and target.path
        yield *key, unit, True, named, _beside(target, part, label) if part and does == "insert" else path, path, *told


_SCOPE = "unit long, read boolean, instrument string, target_path string, anchor_path string"


def _phrases(text: Column, cut: str) -> Column:
    """The places of a lead, without the word `in`."""
    return F.filter(F.transform(F.split(text, cut), lambda x: F.trim(x, F.lit(_GAP))), lambda x: x != "")


# ---------------------------------------------------------------- documents


def _named(blocks: DataFrame, key: str) -> DataFrame:
    """(key, said_act, said_rules, effect): the instruments a document names first, and when it says that it takes effect.

    Blocks are read with the beginning of the next one, so that what goes on behind a block's end is found.
    """
    order = Window.partitionBy(key).orderBy("seq", "text")
    rows = blocks.where(F.col(key).isNotNull()).select(key, "seq", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    said = F.concat_ws("\n", "text", F.substring("next", 1, 200))
    names = arrow_udf(lambda t: t and legal.named_instruments(t), "array<string>")
    effect = arrow_udf(lambda t: dates.effective(t) if t else None, "struct<condition: string, effective_from: date, phrase: string, retrospective: boolean>")
    # Python is called for every row, so blocks without a cue go there as null
    rows = rows.withColumn("of_names", F.when(said.rlike(r"(?i)\b(?:act|rules)\b"), said)).withColumn("of_effect", F.when(said.rlike(r"(?i)\b(?:force|effect|date)"), said))
    rows = rows.withColumn("names", names("of_names")).withColumn("effect", effect("of_effect"))
    first = lambda kind: F.get(F.filter("names", lambda x: x.endswith(kind)), F.lit(0))
    strength = F.when(F.col("effect.condition") == "on_notification", 0).when(F.col("effect.condition") == "on_gazette", 1).otherwise(2)
    least = lambda x, by: F.min_by(x, F.when(x.isNotNull(), by))
    return rows.groupBy(key).agg(least(first("ACT"), F.col("place")).alias("said_act"), least(first("RULES"), F.col("place")).alias("said_rules"), least(F.col("effect"), F.struct(strength, "place")).alias("effect"))


def detected(blocks: DataFrame, key: str) -> DataFrame:
    """A row for each amending clause, with its own date if it has one; `place` counts a document's clauses from 0."""
    blocks = blocks.where(F.col(key).isNotNull()).select(key, "seq", "text")
    tasks = shares(blocks)
    blocks = blocks.repartition(tasks, key)
    rows = _read(units(blocks, key))
    first, second = F.get("strings", F.col("a").cast("int")), F.get("strings", F.col("b").cast("int"))
    bracket, number = F.regexp_extract(first, r"^\s*\(\s*([0-9A-Za-z]{1,4})\s*\)", 1), F.regexp_extract(first, r"^\s*(\d+[A-Z]{0,3})\s*\.", 1)
    label = F.coalesce(F.nullif(bracket, F.lit("")), F.nullif(number, F.lit("")))
    adds = (F.col("does") == "insert") & (F.col("to") == "provision")
    rows = rows.withColumn("label", F.when(adds, F.when(label.rlike(r"^\d"), F.upper(label)).otherwise(F.lower(label)))).withColumn("first", first).withColumn("second", second)
    cue = F.col("body").rlike(r"(?i)\b(?:" + "|".join(v.replace(" ", r"\s+") for v in VERBS) + r")\b")
    inner = F.coalesce(_phrases(F.col("leads"), r"(?i),? ?\bin "), F.array().cast("array<string>"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    verbatim = F.forall("strings", lambda x: F.instr(flat(F.col("raw")), flat(x)) > 0)
    # all that is told of a unit goes through the fold, so units are made and read once; what does not amend is left out there
    told = {"cue": "boolean", "verbatim": "boolean", "does": "string", "to": "string", "position": "string", "first": "string", "second": "string", "label": "string", "day": "date", "told": "string", "body": "string", "blocks": "array<int>"}
    asked = rows.select(
        key, "unit", "numbered", _phrases(F.col("lead"), r"(?i), ?(?:in )?").alias("lead"), inner.alias("inner"), F.trim("loc").alias("loc"), "part", F.col("label").alias("its_label"), F.col("does").alias("its_does"), cue.alias("its_cue"),
        cue.alias("cue"), verbatim.alias("verbatim"), *[n for n in told if n not in ("cue", "verbatim")],
    )
    kinds = ", ".join(f"{n} {kind}" for n, kind in told.items())
    rows = folded(asked, [key], ["unit"], _scoped, f"{key} {asked.schema[key].dataType.simpleString()}, {_SCOPE}, {kinds}", tasks).repartition(tasks, key).join(_named(blocks, key), key)
    rows = rows.withColumn("parsed", F.col("read") & F.col("verbatim")).where("parsed or cue")
    adds = (F.col("does") == "insert") & (F.col("to") == "provision")
    parsed, words = F.col("parsed"), F.col("to") == "words"
    inserts = lambda x: F.when(parsed & (F.col("does") == "insert"), x)
    instrument = F.when(F.col("instrument") == "said_act", F.col("said_act")).when(F.col("instrument") == "said_rules", F.col("said_rules")).otherwise(F.col("instrument"))
    problems = F.array_compact(F.array(
        F.when(~F.col("read"), "grammar_no_match").when(~parsed, "verbatim_failed"), F.when(parsed & adds & F.col("label").isNull(), "new_label_unknown"),
        F.when(parsed & F.col("target_path").isNull(), "target_unresolved"), F.when(instrument.isNull(), "instrument_unresolved"),
    ))
    out = rows.select(
        key, (F.row_number().over(Window.partitionBy(key).orderBy("unit")) - 1).alias("place"), F.when(parsed, "parsed").otherwise("raw").alias("status"), F.when(parsed, F.col("does")).otherwise("amend").alias("op"), F.when(parsed, F.col("to")).otherwise("raw").alias("kind"),
        instrument.alias("instrument"), "target_path", F.when(parsed & adds, F.col("anchor_path")).alias("anchor_path"), inserts(F.when(words, F.lower(F.col("position"))).otherwise("after")).alias("position"), inserts(F.when(words, F.col("first"))).alias("anchor_text"),
        F.when(parsed & words & (F.col("does") != "insert"), F.col("first")).alias("old_text"), F.when(parsed, F.when(words, F.col("second")).otherwise(F.col("first"))).alias("new_text"), F.when(parsed, F.col("label")).alias("new_label"),
        F.col("day").alias("effective_from"), F.col("told").alias("effective_phrase"), F.col("body").alias("unit_text"), "blocks", problems.alias("problems"), "effect",
    )
    sure = F.when(F.col("status") == "raw", 0.0).when(F.size("problems") > 0, DOUBTFUL).otherwise(CLEAR)
    return out.withColumn("confidence", sure)


def proposals(blocks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """A row for each amending clause of notifications: documents (key, doc_date), blocks (key, seq, text).

    The date a clause takes effect is its own, else the notification's, else the day of the gazette.
    """
    rows = detected(blocks, key).join(documents.select(key, "doc_date"), key)
    own, effect = F.col("effective_from").isNotNull(), F.col("effect")
    condition = F.when(own, "on_date").otherwise(F.coalesce(effect["condition"], F.lit("on_gazette")))
    day = F.when(own, F.col("effective_from")).when(condition == "on_date", effect["effective_from"]).when(condition == "on_gazette", F.col("doc_date").cast("date"))
    return rows.withColumns({
        "condition": condition, "effective_from": day, "effective_phrase": F.when(own, F.col("effective_phrase")).otherwise(effect["phrase"]), "retrospective": ~own & F.coalesce(effect["retrospective"], F.lit(False)),
    }).drop("effect", "doc_date")


def review_status(status: Column, problems: Column, resolved: Column) -> Column:
    """needs_info for what could not be read, has problems or no target; proposed for the rest."""
    return F.when((status == "parsed") & (F.size(problems) == 0) & resolved, "proposed").otherwise("needs_info")
