"""Amending clauses: golden notices of our own, and awkward rows."""

from datetime import date

from lexloom.operators import amendments

NOTICE = [
    "In exercise of powers, these rules further to amend the Central Goods and Services Tax Rules, 2017, namely:-", "2. In the said rules (hereinafter the principal rules), in rule 31,-", "(a) in sub-rule (2), for the words “a toll; or dues”, the words “dues” shall be substituted;",
    "(b) sub-rule (4) shall be omitted with effect from 1st July, 2022;", "3. In the said rules, after rule 40, the following rule shall be inserted, namely:-", "“40A. Rafts.- A raft waits; then it goes.”;", "4. In rule 52, before the word “boat”, insert the word “long”;",
    "5. Rule 60 is rescinded, whatever it says.", "6. Some boats are long.",
]


def frame(spark, lines):
    return spark.createDataFrame([("n", k, line) for k, line in enumerate(lines)], "d string, seq int, text string").repartition(3)


def found(spark, lines):
    return amendments.detected(frame(spark, lines), "d").orderBy("place").collect()


def test_clauses(spark):
    got = found(spark, NOTICE)
    assert [(p["op"], p["kind"], p["target_path"], p["instrument"]) for p in got] == [("substitute", "words", "r31.2", "CGST_RULES"), ("omit", "provision", "r31.4", "CGST_RULES"), ("insert", "provision", "r40A", "CGST_RULES"), ("insert", "words", "r52", "CGST_RULES"), ("amend", "raw", None, "CGST_RULES")]
    assert (got[0]["old_text"], got[0]["new_text"], got[0]["blocks"]) == ("a toll; or dues", "dues", [2])
    assert (got[1]["effective_from"], got[2]["new_label"], got[2]["anchor_path"], got[2]["blocks"]) == (date(2022, 7, 1), "40A", "r40", [4, 5])
    assert (got[3]["anchor_text"], got[3]["position"], got[3]["new_text"]) == ("boat", "before", "long")
    assert [p["confidence"] for p in got] == [0.9, 0.9, 0.9, 0.9, 0.0] and got[4]["problems"] == ["grammar_no_match"]


def test_units_stay_whole_inside_quotes(spark):
    rows = amendments.units(frame(spark, ['a; "b; c"\n"d"; e\nf', 'g "h', 'i; j" k; "open; to', "the end; of all"]), "d").orderBy("unit").collect()
    assert [r.raw for r in rows] == ["a", ' "b; c"\n"d"', " e", "f", 'g "h\ni; j" k', ' "open; to\nthe end; of all']
    assert [(list(r.strings), r.shaped, list(r.blocks)) for r in rows[4:]] == [(["h\ni; j"], "g §0§ k", [1, 2]), ([], ' "open; to\nthe end; of all', [2, 3])]
    assert list(rows[1].strings) == ["b; c", "d"]


def test_problems_and_review(spark):
    assert found(spark, ["in rule 4, for the words “x”, the words “y” shall be substituted"])[0]["problems"] == ["instrument_unresolved"]
    assert found(spark, ["after rule 4 of the CGST Rules, the following rule shall be inserted, namely:- “no number”"])[0]["problems"] == ["new_label_unknown", "target_unresolved"]
    rows = spark.createDataFrame([("parsed", [], True), ("parsed", [], False), ("raw", [], True), ("parsed", ["p"], True)], "status string, problems array<string>, hit boolean")
    states = rows.select(amendments.review_status(rows.status, rows.problems, rows.hit).alias("x")).collect()
    assert [r.x for r in states] == ["proposed", "needs_info", "needs_info", "needs_info"]


def test_dates_of_clauses(spark):
    docs = spark.createDataFrame([("n", date(2021, 3, 1))], "d string, doc_date date")
    clause = "In rule 4 of the CGST Rules, omit the word “x”; omit the word “y” w.e.f. 2nd May, 2020"
    day = lambda *lines: [(p.condition, p.effective_from) for p in amendments.proposals(frame(spark, [clause, *lines]), docs, "d").orderBy("place").collect()]
    assert day() == [("on_gazette", date(2021, 3, 1)), ("on_date", date(2020, 5, 2))]
    assert day("They come into force on", "the 1st April, 2021.")[0] == ("on_date", date(2021, 4, 1))
    assert day("These rules come into force on the 1st April, 2021.", "They take effect on such date as the Government may notify")[0] == ("on_notification", None)


def test_awkward_rows(spark):
    """Nulls, ties, long texts, clashing columns, odd signs: no failure, and clauses beside them are found."""
    clause = "In rule 4 of the CGST Rules, omit the word “x”"
    rows = [("a", 0, None, 1), ("a", 1, clause, 1), ("a", 1, clause, 1), (None, 0, clause, 1), ("b", None, "§0§ shall be omitted", 1), ("b", 1, "in a, " * 40_000 + "omitted", 1), ("b", 2, "-, " * 60_000 + clause, 1), ("c", 0, "; " * 50_000 + clause, 1), ("c", 1, "An open “quote shall be omitted", 1)]
    df = spark.createDataFrame(rows, "d string, seq int, text string, place int")
    got = sorted((r.d, r.place, r.op, r.kind, r.target_path) for r in amendments.detected(df, "d").collect())
    assert [g for g in got if g[0] == "a"] == [("a", 0, "omit", "words", "r4"), ("a", 1, "omit", "words", "r4")]
    assert ("c", 0, "omit", "words", "r4") in got and not any(g[0] is None for g in got)
    assert amendments.detected(df.limit(0), "d").collect() == []
