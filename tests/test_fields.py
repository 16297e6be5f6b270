"""Fields of documents: golden rows, what contradicts itself, long documents and awkward texts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.operators import fields

TODAY = "2020-01-01"
BLOCKS, DOCS = "k long, seq int, kind string, text string", "k long, doc_type string, title string, file_name string"


def para(*texts):
    return [("para", t) for t in texts]


def read(spark, documents, today=TODAY):
    """documents (type, blocks, title, file's name) as rows, in order."""
    blocks = [(k, n, *block) for k, (_, own, *_) in enumerate(documents) for n, block in enumerate(own)]
    docs = [(k, kind, title, name) for k, (kind, _, title, name) in enumerate(documents)]
    got = fields.fields(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(docs, DOCS), "k", F.lit(today).cast("date"))
    return [r.asDict() for r in got.orderBy("k").collect()]


def test_fields_and_what_contradicts_them(spark):
    ntf, nothing, order, act, memo, none = read(
        spark,
        [
            ("notification", para("Notification No. 12/2019 - Central Tax", "dated the 8th March, 2019"), "No. 13/2019", None),
            ("notification", para("nothing"), "", None),
            ("order", para("Order No. 6/2018", "dated 7th May, 2021"), None, None),
            ("act", para("x", "THE CANAL TOLLS ACT, 2015"), "", None),
            ("memo", para("A NOTE ON BOATS"), "", "n.pdf"),
            (None, para(None, ""), None, None),
        ],
    )
    assert (ntf["fields"]["canonical_id"], ntf["confidence"]["number"], ntf["issues"]) == ("ntf:CT:12/2019", 0.475, ["crosscheck:number disagrees with title"])
    assert ntf["confidence"]["canonical_id"] == 0.475 and ntf["confidence"]["year"] == 0.95 and ntf["fields"]["title"] == "Notification No. 12/2019"
    assert nothing["issues"] == ["missing:doc_date", "missing:number", "missing:series", "missing:year"]
    assert order["issues"] == ["crosscheck:doc_date out of range: 2021-05-07"]
    assert act["fields"]["title"] == "THE CANAL TOLLS ACT, 2015"
    assert memo["fields"] == {"title": "A NOTE ON BOATS", "doc_type": "memo"}
    assert (none["fields"], none["confidence"], none["issues"]) == ({}, {}, ["missing:title"])


def test_fields_of_judgements(spark):
    lines = para("IN THE SUPREME COURT OF INDIA", "Civil Appeal No. 0044 of 2020 with SLP (C) No. 5 of 2019", "Boat Company ....... Appellant(s)", "The Canal ....... the Respondent", "DIVISION BENCH", "CORAM : Dr. Justice N. Weir, R. Lock", "It is ordered.", "dated 9th May, 2021")
    later = para(*["of no use"] * 40, "A. v. B in the Delhi High Court, Writ Petition No. 007 of 2011", "dated 1.2.2012", "dated 3rd March 2013")
    got, body = (r["fields"] for r in read(spark, [("judgement", lines, "", None), ("judgement", later, "", None)], "2030-01-01"))
    assert (got["court_code"], got["case_numbers"], got["decision_date"], got["canonical_id"]) == ("SC", "CA 44/2020; SLP(C) 5/2019", "2021-05-09", "jdg:SC:CA44/2020:2021-05-09")
    assert (got["petitioners"], got["respondents"], got["judges"], got["bench"]) == ("Boat Company", "The Canal", "N. Weir; R. Lock", "DIVISION BENCH")
    assert got["title"] == "Boat Company v. The Canal"
    assert (body["court_code"], body["case_numbers"], body["decision_date"]) == ("HC-DL", "WP 7/2011", "2012-02-01")


def test_several_names_on_a_side_and_in_one_line(spark):
    lines = para("A. Lock .. Petitioner B. Weir ... petitioners", "C. Sluice", ".... Respondent(s)", "A. Lock .. Petitioner", ".. Applicant", "Hon'ble Shri D. Dam, J. and Smt. E. Quay, JJ.")
    got = read(spark, [("judgement", lines, "", None)])[0]["fields"]
    assert (got["petitioners"], got["respondents"]) == ("A. Lock; B. Weir", "C. Sluice")
    assert got["judges"].split("; ")[0] == "D. Dam"


def test_forms_of_numbers_series_and_titles(spark):
    long = [("table_row", f"row {k}") for k in range(300)]
    rows = read(
        spark,
        [
            ("circular", para("Circular No. 4/5", "Subject: Boats and rafts DIN 1"), "", "9_8_2019.pdf"),
            ("circular", para("no number"), "Circular 7/8/2019", "07_8_2019.pdf"),
            ("notification", para("Notf. No. 007/2018", "Compensation Cess (Rate)", "G. S. R. 12 (E)", "shall come into force on the 1st day of July, 2018"), "", None),
            ("notification", [("heading", "Of boats and tolls"), *para("SCHEDULE OF TOLLS IN FULL"), *long, ("para", "Notification No. 1/2019 - Central Tax")], "", "3-2019"),
            ("rules", para("The rules", "BOAT TOLLS RULES, 2019 in part", "BOAT TOLLS RULES, 2019", "Under section 9 of the CGST Act. Section 9 CGST and rule 3 of the CGST Rules; see rule."), "", None),
        ],
    )
    two, named, short, far, rules = ((r["fields"], r["confidence"], r["issues"]) for r in rows)
    assert (two[0]["number"], two[0]["title"], two[2]) == ("4/5", "Boats and rafts", ["invalid_canonical: circular", "missing:doc_date"])
    assert (named[0]["canonical_id"], named[1]["number"], named[1]["canonical_id"]) == ("cir:07/8/2019", 0.25, 0.25)
    assert (short[0]["number"], short[0]["series"], short[0]["gazette_ref"], short[0]["in_force_date"], short[1]["series"]) == ("7", "COMP(R)", "G.S.R. 12(E)", "2018-07-01", 0.7)
    assert (far[0]["number"], far[1]["number"], far[0]["title"]) == ("3", 0.5, "Of boats and tolls")
    assert (rules[0]["title"], rules[0]["sections_referred"], rules[1]["sections_referred"]) == ("BOAT TOLLS RULES, 2019", "prov:CGST_ACT:s9; prov:CGST_RULES:r3", 0.8)


def test_most_sections_stay(spark):
    many = para(*[f"section {k} of the CGST Act." for k in range(1, 401)])
    told = read(spark, [("rules", many, "", None)])[0]["fields"]["sections_referred"].split("; ")
    assert told == [f"prov:CGST_ACT:s{k}" for k in range(1, fields.MOST_SECTIONS + 1)]


def test_awkward_texts_end_soon(spark):
    texts = ["x" * 300_000, "A " * 100_000, ". " * 100_000, "..." * 60_000, "CORAM " * 20_000, "Subject: " * 20_000, "\x00\ud7ff é", "No. 1/ 2" * 9_000, "(((", "Notification No. ٣/2019 - ٤"]
    rows = read(spark, [(kind, para(t, None, t), t, t) for t in texts for kind in ("judgement", "notification", "circular", "act")])
    assert len(rows) == 4 * len(texts) and all(r["fields"]["doc_type"] for r in rows)


def test_series_as_the_parser_finds_them(spark):
    said = [n for names in legal.SERIES.values() for n in names] + ["Central  Tax (Rate) of 2019", "tax", "t", "", "boats", "integrated tax and ut(r)", "CENTRAL TAX dated"]
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", fields.series_code(F.col("x")).alias("code")).collect()
    assert [r["code"] for r in rows] == [legal.series_of(r["x"]) for r in rows]


@pytest.mark.parametrize(("doc_type", "own", "sure", "least"), [("act", {"title": "t"}, {"title": 0.7}, 0.7), ("order", {"number": "1"}, {"number": 0.9}, 0.0), (None, {"title": "t"}, {"title": 0.5}, 0.5)])
def test_least_sure(spark, doc_type, own, sure, least):
    row = spark.createDataFrame([(doc_type, own, sure)], "t string, f map<string, string>, c map<string, double>")
    assert row.select(fields.least_sure(F.col("t"), F.col("f"), F.col("c"))).first()[0] == least


def test_no_blocks_and_repeated_blocks(spark):
    empty = fields.fields(spark.createDataFrame([], BLOCKS), spark.createDataFrame([(1, "act", "", "")], DOCS), "k", F.lit(TODAY).cast("date"))
    assert empty.count() == 0
    got = read(spark, [("order", para("Order No. 6/2018", "Order No. 6/2018", "dated 7th May, 2019") * 2, "", None)])[0]
    assert got["fields"]["canonical_id"] == "ord:6/2018" and date.fromisoformat(got["fields"]["doc_date"]) == date(2019, 5, 7)
