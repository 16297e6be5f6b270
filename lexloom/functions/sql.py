"""The text functions under SQL names, for spark.sql: scalar ones, and a table function for citations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import amend, dates, ids, legal, text

SCALARS = {
    "legal_locator": (legal.locator, "struct<path: string, relative: boolean, instrument: string>"),
    "looks_like_citation": (legal.looks_like_citation, "boolean"),
    "roman_number": (lambda x: legal.roman(x or ""), "int"),
    "parsed_id": (ids.parsed, f"struct<{ids.PARTS}>"),
    "legal_day": (lambda x: dates.parse_day(x or ""), "date"),
    "words_at": (lambda source, needle: [{"start": a, "end": b} for a, b in amend.places(source or "", needle or "")], "array<struct<start: int, end: int>>"),
}
NUMBER = r"[^\d]*(\d+)"


class Citations:
    """A row for each citation in a text."""

    def eval(self, said: str | None) -> Iterator[tuple]:
        for c in legal.citations(said):
            parts = ids.parsed(c["canonical_id"]) or {}
            yield c["kind"], c["raw"], c["canonical_id"], c["ambiguous"], parts.get("number")


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, in place of those of a registration before."""
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
    for name, f in (("normalise_text", text.normalise_text), ("word_diff", text.word_diff), ("simhash64", text.simhash64)):
        spark.udf.register(name, f)
    spark.udtf.register("legal_citations", F.udtf(Citations, returnType="kind: string, raw: string, canonical_id: string, ambiguous: boolean, number: string"))
