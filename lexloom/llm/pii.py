"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a DataFrame expression; no Python runs on the executors and nothing is shuffled. Kinds of the base:
email, ip, card, phone. The method adds `iban` (as long as its country says, one word for other countries; mod-97) and, where a context word stands close before it, `phone_local`
(a number without a plus sign), so base spans always stay.

Possessive quantifiers and look-behinds keep each pattern linear in the text: a run of characters is entered once only.
Defined cases: a null or empty text has no spans; repeated rows are each judged; spans of several kinds that begin at one
place are all kept, in the order of the kinds; very long texts are read whole, in time that grows with their length and
little more with the number of matches; an empty table gives no rows; other columns are not touched. Positions count code
points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: How long a country's IBAN is (the registry, then countries that use the format without being in it).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
for _n, _codes in {25: "AO CV GW MZ", 26: "DZ IR", 27: "CF CG CM GA GQ KM MG TD", 28: "BF BJ CI MA ML NE SN TG"}.items():
    IBAN_LENGTHS[_n] += f" {_codes}"
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
_COUNTRIES = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")

#: How each kind looks. A run of e-mail characters is entered at its start or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+)(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9A-Za-z+.-])(?<![0-9] )\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![ .-]?[0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

#: What a text must have to be searched at all, and words that raise a span's score.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": "+", "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", "phone_local": r"[0-9]{3}[ .-]?[0-9]{3}"}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax"),
}
#: Scores: what a confirmed span has by itself, and what a context word within NEAR characters before it adds.
SCORE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.9, "phone_local": 0.3}
NEAR, BONUS, LEAST = 40, 0.3, 0.5
#: Characters of the chunks in which a text is redacted.
CHUNK = 1000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether the letters and digits, first four moved to the end, leave 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        d = F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (acc * F.when(d > 9, 100).otherwise(10) + d) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "ip": lambda: value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda: n.between(12, 19) & _luhn(value),
        "phone": lambda: n.between(9, 15),
        "iban": lambda: _mod97(value),
        "phone_local": lambda: n.between(7, 11),
    }.get(kind, lambda: F.lit(True))()


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """fold from 0 up to and with each element of an array that is not empty.

    It goes in blocks of about the square root of the array's size, so that a text full of matches stays cheap.
    """

    def prefix(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), F.array().cast("array<int>").alias("all"))

        def step(acc: Column, x: Column) -> Column:
            now = fold(acc["now"], x)
            return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

        return F.aggregate(part, start, step)["all"]

    def over(blocks: Column) -> Column:
        whole = prefix(F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), fold)), F.lit(0))
        return _bound(whole, lambda upto: F.flatten(F.transform(blocks, lambda part, i: prefix(part, F.when(i > 0, F.element_at(upto, i)).otherwise(0)))))

    def cut(values: Column) -> Column:
        n = F.size(values)
        size = F.ceil(F.sqrt(n)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))

    return _bound(values, lambda v: _bound(cut(v), over))


def _found(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, value, score>> of one kind, in order.

    The text is cut at the matches; the lengths of the pieces and matches before a match give its place, and the piece and
    match before it its context, so that the whole text is walked once however many matches it has.
    """
    pattern = F.lit(PATTERNS[kind])
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)

    def placed(both: Column) -> Column:
        values, pieces = both["values"], both["pieces"]
        steps = F.transform(values, lambda v, i: F.length(F.element_at(pieces, i + 1)) + F.length(v))

        def made(ends: Column) -> Column:
            return F.transform(values, lambda v, i: _span(kind, v, F.element_at(ends, i + 1), _before(values, pieces, i)))

        return F.filter(_bound(_running(steps, lambda a, x: a + x), made), lambda x: _confirmed(kind, x["value"]) & ((x["score"] >= LEAST) if kind not in BASE else F.lit(True)))

    empty = F.array().cast(SPANS)
    needs = text.contains(NEEDS[kind]) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    both = _bound(F.struct(values.alias("values"), pieces.alias("pieces")), lambda both: F.when(F.size(both["values"]) > 0, placed(both)).otherwise(empty))
    return F.when(needs, both).otherwise(empty)


SPANS = "array<struct<kind: string, start: int, end: int, value: string, score: double>>"


def _before(values: Column, pieces: Column, i: Column) -> Column:
    """The last NEAR characters before match i, over one match back at most."""
    end = lambda x: F.right(x, F.lit(NEAR))
    back = F.when(i > 0, F.concat(end(F.element_at(pieces, i)), end(F.element_at(values, i)))).otherwise("")
    return end(F.concat(back, end(F.element_at(pieces, i + 1))))


def _span(kind: str, value: Column, end: Column, near: Column) -> Column:
    told = F.lower(near).rlike(r"\b(?:" + "|".join(CONTEXT[kind]) + r")")
    score = F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(told, BONUS).otherwise(0.0))
    return F.struct(F.lit(kind).alias("kind"), (end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), score.alias("score"))


def with_spans(docs: DataFrame, name: str = "pii_spans") -> DataFrame:
    """docs with one more column: all spans, by start, then by kind in the order of KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    found = F.concat(*[_found(kind, text) for kind in KINDS])
    by_place = F.transform(found, lambda x: F.struct(x["start"].alias("s"), place[x["kind"]].alias("k"), x.alias("x")))
    return docs.withColumn(name, F.transform(F.array_sort(by_place), lambda x: x["x"]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans as text."""
    got = with_spans(docs.select("doc_id", "text")).select("doc_id", "pii_spans")
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE))
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; n_chars, where it is a column, follows.

    Spans that overlap are replaced together, by the kind of the first. The text is cut into chunks first, so that a kept
    part costs its own length and not a walk from the text's start.
    """
    name = "pii_spans"
    while name in docs.columns:
        name += "_"
    text = F.coalesce(F.col("text"), F.lit(""))

    def joined(chunks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
            return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), a - first * CHUNK + 1, b - a)

        def over(reach: Column) -> Column:
            before = F.transform(name, lambda x, i: F.struct(F.when(i > 0, F.element_at(reach, i)).otherwise(0).alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
            own = F.filter(before, lambda x: x["start"] >= x["at"])  # others begin inside a span before them
            kept = F.transform(own, lambda x: F.concat(cut(x["at"], x["start"]), F.lit("["), x["kind"], F.lit("]")))
            return F.concat(F.array_join(kept, ""), cut(F.element_at(reach, -1), F.length(text)))

        return _bound(_running(F.transform(name, lambda x: x["end"]), lambda a, x: F.greatest(a, x)), over)

    done = _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), joined)
    out = with_spans(docs, name)
    out = out.withColumn("text", F.when(F.size(name) > 0, done).otherwise(F.col("text"))).drop(name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
