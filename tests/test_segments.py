"""Structure paths: golden documents of our own, and awkward rows."""

import pytest

from lexloom.operators import segments


def para(*lines):
    return [("para", x) for x in lines]


def read(spark, doc_type, blocks):
    rows = [("d", doc_type, k, kind, text) for k, (kind, text) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "d string, doc_type string, seq int, kind string, text string").repartition(3)
    paths = [r.path for r in segments.segmented(df, "d").orderBy("seq").collect()]
    return paths, [(r.prefix, r.label) for r in segments.numbered_items(df, "d").orderBy("seq").collect()]


def test_laws(spark):
    lines = para("THE CANAL LAW", "CHAPTER IV", "7. (1) Boats pay", "(2) Rafts wait", "(a) long ones", "(ii) in rain", "(b) short ones", "Provided that it rains", "Explanation 1. rain", "8. Locks", "40. too far", "(h) gates", "(i) bars", "3Inserted vide Act 9 of 2018", "FORM LOCK-1", "SCHEDULE II", "more")
    paths = ["pre", "ch4", "ch4.s7.1", "ch4.s7.2", "ch4.s7.2.a", "ch4.s7.2.a.ii", "ch4.s7.2.b", "ch4.s7.2.b.prov1", "ch4.s7.2.b.expl1", "ch4.s8", "ch4.s8", "ch4.s8.h", "ch4.s8.i", "ch4.s8.i.fn1", "form1", "sched1", "sched1"]
    assert read(spark, "act", lines) == (paths, [("s", "7"), ("s", "8")])


def test_contents_and_tables(spark):
    front = para("ARRANGEMENT OF RULES", "1. Boats", "2. Rafts", "THE CANAL RULES, 2016", "An opening", "1. Boats pay") + [("table", "t"), ("table_row", "9. | x")] + para("2. Rafts wait")
    assert read(spark, "rules", front) == (["toc", "toc", "toc", "pre", "pre", "r1", "r1", "r1", "r2"], [("r", "1"), ("r", "2")])
    unended = para("CONTENTS", "1. Boats", "2. Rafts")
    assert read(spark, "rules", unended)[0] == ["pre", "r1", "r2"]


@pytest.mark.parametrize(
    ("doc_type", "blocks", "paths"),
    [
        ("notification", para("Opening", "1. Boats", "in rule 3, a word shall be omitted", "more", "2. Rafts", "Table") + [("table_row", "a"), ("table_row", "b")] + para("more", "3. End") + [("table_row", "c")], ["pre", "p1", "p1.i1", "p1.i1", "p2", "sched1", "sched1.row1", "sched1.row2", "sched1", "p3", "sched2.row1"]),
        ("order", para("To all", "1. Boats", "1.2 Long boats", "more"), ["hdr", "p1", "p1.2", "p1.2"]),
        ("judgement", para("Court", "DISCUSSION", "one", "7. two", "A HEADING", "three"), ["hdr", "findings", "findings.p1", "findings.p7", "findings", "findings.p3"]),
        ("judgement", para("Court", "1. one", "two"), ["hdr", "body.p1", "body.p2"]),
        ("memo", para("a", "b"), ["p1", "p2"]),
        (None, para("a"), ["p1"]),
    ],
)
def test_other_types(spark, doc_type, blocks, paths):
    assert read(spark, doc_type, blocks)[0] == paths


def test_awkward_rows(spark):
    """Nulls, ties, long texts, clashing columns: every block with a key has a path; texts that open nothing carry the last."""
    long = "x " * 200_000
    rows = [("a", "act", 0, None, None, 1), ("a", "act", 1, "para", "1. Boats", 1), ("a", "act", 1, "para", "1. Boats", 1), ("a", "act", 2, "para", long, 1), (None, "act", 0, "para", "1. Boats", 1), ("b", "circular", None, "para", long, 1)]
    df = spark.createDataFrame(rows, "d string, doc_type string, seq int, kind string, text string, place int")
    got = sorted((r.d, r.seq or 0, r.path) for r in segments.segmented(df, "d").collect())
    assert got == [("a", 0, "pre"), ("a", 1, "s1"), ("a", 1, "s1"), ("a", 2, "s1"), ("b", 0, "hdr")]
    assert segments.segmented(df.limit(0), "d").collect() == []
    assert segments.segmented(df.drop("kind"), "d").count() == 5


def test_a_numeral_that_is_none_opens_nothing(spark):
    assert read(spark, "act", para("CHAPTER II", "CHAPTER IIX", "1. Boats"))[0] == ["ch2", "ch2", "ch2.s1"]
