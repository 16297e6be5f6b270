"""Text functions as column expressions, and the few that need Python as Arrow UDFs."""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def count_tokens(text: Column) -> Column:
    """A quarter more than the words, rounded down, 1 at least; 0 for an empty text."""
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.size(words(text)) * 1.25))).cast("long")


def detect_lang(text: Column) -> Column:
    """hi where over 0.3 of the letters are Devanagari, en where there are other letters, else null."""
    hindi, letters = F.regexp_count(text, F.lit(r"[\x{0900}-\x{0963}\x{0970}-\x{097F}]")), F.regexp_count(text, F.lit(r"[\p{L}\x{0900}-\x{0963}\x{0970}-\x{097F}]"))
    return F.when(letters == 0, None).when(hindi / letters > 0.3, "hi").otherwise("en")


def garble_score(text: Column) -> Column:
    """Bad characters per non-space character plus half the share of tokens that are no words, at most 1.

    A bad character is of the private use area or a replacement character; `(cid:N)` counts five.
    """
    solid = F.regexp_count(text, F.lit(r"\S"))
    bad = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}\x{FFFD}]")) + 5 * F.regexp_count(text, F.lit(r"\(cid:[0-9]+\)"))
    pieces = words(text)
    odd = F.size(F.filter(pieces, lambda x: F.regexp_count(x, F.lit(r"[^\p{L}\p{N}_]")) / F.length(x) > 0.4))
    return F.when(solid == 0, 0.0).otherwise(F.least(F.lit(1.0), bad / solid + 0.5 * odd / F.size(pieces)))


def para_label(text: Column) -> Column:
    """A leading number or letter in the forms `1.`, `(a)`, `iv)`; empty string where there is none."""
    found = F.regexp_extract(F.concat(text, F.lit(" ")), r"^(\(?(?:[0-9]{1,3}|[a-z]{1,3}|[ivxlc]{1,6})[.)])\s", 1)
    return F.regexp_replace(found, r"\.$", "")


#: How the parts of a structure path are told, by their first letters; a missing number counts 1 where it may.
PATH_WORDS = ((r"^ch([0-9]+)$", "Chapter ", False), (r"^s([0-9]+)$", "s.", False), (r"^r([0-9]+)$", "r.", False), (r"^prov(.*)$", "Proviso ", True), (r"^expl(.*)$", "Explanation ", True), (r"^sched(.*)$", "Schedule ", False))


def heading_path(instrument: Column, path: Column, heading: Column) -> Column:
    """The instrument's name and a structure path in words: chapters, sections, rules, provisos, explanations, schedules and bracketed parts."""

    def told(x: Column) -> Column:
        out = F.when(F.lit(False), x)
        for pattern, name, numbered in PATH_WORDS:
            rest = F.regexp_extract(x, pattern, 1)
            out = out.when(x.rlike(pattern), F.concat(F.lit(name), F.when(rest == "", "1").otherwise(rest) if numbered else rest))
        return out.when(x.rlike(r"^(?:[0-9]+|\p{L}+)$"), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)

    joined = F.array_join(F.concat(F.array(instrument), F.transform(F.split(path, r"\."), told)), " > ")
    return F.concat(joined, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" - "), heading)).otherwise(F.lit("")))


def document_heading(title: Column, path: Column, label: Column) -> Column:
    """A document's title, a path in it and a paragraph's label that is not the path."""
    return F.concat_ws(" > ", title, F.nullif(path, F.lit("")), F.when((label != "") & (F.coalesce(path, F.lit("")) != label), F.concat(F.lit("Para "), label)))


_DASHES = dict.fromkeys(map(ord, "–—−‐"), "-") | dict.fromkeys(map(ord, "‘’"), "'") | dict.fromkeys(map(ord, "“”"), '"')
_SPACES = re.compile(r"\s+")


def plain(text: str) -> str:
    """Compatibility form, plain dashes and quotes, single spaces, no fold of case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DASHES)
    return _SPACES.sub(" ", text).strip()


@F.arrow_udf(StringType())
def normalise_text(texts: pa.Array) -> pa.Array:
    """Texts are taken out of the batch one by one, so that Python never holds all of them as objects."""
    return pa.array((None if (x := value.as_py()) is None else plain(x) for value in texts), pa.string(), size=len(texts))


def simhash(text: str) -> int:
    """A signed 64-bit similarity hash of three-word shingles (of words, if there are fewer): bits that most shingles' hashes have."""
    found = re.findall(r"\w+", plain(text).lower())
    grams = list(map(" ".join, zip(found, found[1:], found[2:], strict=False))) or found
    if not grams:
        return 0
    hashes = b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams)
    ones = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(t) else simhash(t) for t in texts], dtype="Int64")  # beside a null, plain numbers would be rounded


def marked_diff(old: str, new: str) -> str:
    """Words taken out as [-x-] and words put in as {+y+}, between the runs that stay."""
    before, after = re.findall(r"\s+|\S+", old), re.findall(r"\s+|\S+", new)
    out: list[str] = []
    a = b = 0
    for run in difflib.SequenceMatcher(None, before, after, autojunk=False).get_matching_blocks():
        gone, come = before[a : run.a], after[b : run.b]
        marks = [f"[-{''.join(gone).strip()}-]"] * bool(gone) + [f"{{+{''.join(come).strip()}+}}"] * bool(come)
        a, b = run.a + run.size, run.b + run.size
        out += [*marks, " " if marks else "", *before[run.a : a]]
    return re.sub(r" {2,}", " ", "".join(out)).strip()


@F.pandas_udf(StringType())
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else marked_diff(a, b) for a, b in zip(old, new, strict=True)], dtype=object)
