"""Functions on legal text: golden rows of our own, and what must hold for any text."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.functions import amend, dates, html, ids, legal, lexemes, text
from lexloom.operators import law

CANAL = "A boat that enters the canal pays a toll of nine coins, and a raft pays a toll too."


@pytest.mark.parametrize(
    ("said", "path"),
    [
        ("clause (b) of sub-section (3) of section 41", "s41.3.b"), ("rule 12(5)(d)(ii)", "r12.5.d.ii"), ("rule 7 of the IGST Rules", "r7"), ("the third proviso to sub-rule (2) of rule 9", "r9.2.prov3"),
        ("proviso to section 8A", "s8A.prov1"), ("Explanation 4 to section 6", "s6.expl4"), ("item (iv) of clause (e) of section 70", "s70.e.iv"), ("Form REG 09", None), ("Schedule II", None), ("what the boat pays", None), ("", None),
    ],
)
def test_locator(said, path):
    got = legal.locator(said)
    assert (got and got["path"]) == path


def test_relative_locators_need_a_parent():
    assert legal.locator("clause (f) of sub-rule (1)") == {"path": None, "relative": True, "instrument": None}
    assert legal.locator("clause (f) of sub-rule (1)", "r77")["path"] == "r77.1.f"
    assert legal.locator("rule 3 of the said rules")["instrument"] == "said_rules"
    assert legal.place_of("Schedule II").is_provision is False


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("relief under s. 31(4)(d) CGST Act", ["prov:CGST_ACT:s31.4.d"]), ("see rule 22(3) of the CGST Rules", ["prov:CGST_RULES:r22.3"]), ("by Notification No. 9/2021-Central Tax", ["ntf:CT:9/2021"]),
        ("Circular No. 44/3/2019", ["cir:44/3/2019"]), ("section 12 of no act", [None]), ("how boats pay", []), ("", []),
    ],
)
def test_citations(said, found):
    assert [c["canonical_id"] for c in legal.citations(said)] == found


@given(st.text(max_size=200))
@settings(deadline=None, max_examples=60)
def test_parsers_never_raise(said):
    legal.citations(said)
    legal.locator(said)
    legal.numbering(said)
    legal.looks_like_citation(said)
    ids.parsed(said)
    html.blocks(said)
    dates.effective(said)
    lexemes.parsed(said)
    lexemes.snippet(lexemes.parsed(said), said)
    assert text.plain(text.plain(said)) == text.plain(said)


@pytest.mark.parametrize(("numeral", "value"), [("vi", 6), ("XLII", 42), ("iix", None), ("vv", None), ("q", None), ("", None)])
def test_roman(numeral, value):
    assert legal.roman(numeral) == value


def test_numbering_and_cues():
    assert [t["value"] for t in legal.numbering("[14 . ( 2 )(a) A raft")] == ["14", "2", "a", "A raft"]
    assert legal.numbering("ANNEXURE B of rates")[0] == {"kind": "annex", "value": "B"}
    assert [legal.looks_like_citation(x) for x in ("under s.9", "rule 4", "rules of boats", "notif 3/2020")] == [True, True, False, True]


@pytest.mark.parametrize(
    ("kind", "parts", "value"),
    [
        ("ntf", {"series": "CT(R)", "number": 4, "year": 2019}, "ntf:CT(R):4/2019"), ("cir", {"a": 10, "b": 2, "year": 2020}, "cir:10/2/2020"), ("ins", {"number": 3, "year": 2022}, "ins:3/2022"), ("ord", {"number": 8, "year": 2018}, "ord:8/2018"),
        ("jdg", {"court": "HC-KL", "case": "wp (c) 5 – 2020", "decided": "2021-06-30"}, "jdg:HC-KL:WP(C)5-2020:2021-06-30"), ("inst", {"instrument": "igst"}, None), ("ord", {"number": "x", "year": 2018}, None),
        ("jdg", {"court": "SC", "case": "CA 1", "decided": "2021-02-30"}, None), ("ntf", {"series": "CT", "number": 4}, None),
    ],
)
def test_identifiers(kind, parts, value):
    assert ids.made(kind, **parts) == value
    if value:
        back = ids.parsed(value)
        assert ids.made(kind, **{k: back[k] for k in parts}) == value


def test_identifiers_of_unknown_documents():
    assert ids.provisional("0123456789abcdef99") == "unk:0123456789abcdef"
    assert [ids.parsed(x) for x in ("unk:xyz", "boat:1", None, "cir:1/2")] == [None] * 4


OPS = [
    ({"kind": "substitute_words", "old_text": "nine coins", "new_text": "two coins"}, CANAL.replace("nine", "two"), None),
    ({"kind": "substitute_words", "old_text": "oars", "new_text": "sails"}, CANAL, "old_text_not_found"),
    ({"kind": "substitute_words", "old_text": "a toll", "new_text": "dues"}, CANAL, "old_text_ambiguous"),
    ({"kind": "substitute_words", "old_text": "a toll", "new_text": "dues", "occurrence": 2}, CANAL[::-1].replace("a toll"[::-1], "dues"[::-1], 1)[::-1], None),
    ({"kind": "substitute_words", "old_text": "a toll", "new_text": "dues", "occurrence": 3}, CANAL, "old_text_occurrence_out_of_range"),
    ({"kind": "substitute_words", "old_text": None, "new_text": "sails"}, CANAL, "words_missing"),
    ({"kind": "substitute_words", "old_text": "canal", "new_text": None}, CANAL, "words_missing"),
    ({"kind": "omit_words", "old_text": "too"}, CANAL.replace(" too", ""), None),
    ({"kind": "insert_words", "anchor_text": "nine coins", "new_text": "or more"}, CANAL.replace("coins", "coins or more"), None),
    ({"kind": "insert_words", "anchor_text": "raft", "new_text": "long", "position": "before"}, CANAL.replace("raft", "long raft"), None),
    ({"kind": "insert_words", "anchor_text": "ferry", "new_text": "long"}, CANAL, "anchor_not_found"),
    ({"kind": "insert_provision", "new_text": "A ferry pays nothing."}, CANAL, "provision_exists"),
    ({"kind": "substitute_provision", "new_text": None}, CANAL, "new_text_missing"),
    ({"kind": "omit_provision"}, None, None),
]


@pytest.mark.parametrize(("op", "result", "reason"), OPS)
def test_operations(op, result, reason):
    assert amend.applied(CANAL, op) == (result, reason)


def test_operations_without_a_provision():
    assert amend.applied(None, {"kind": "omit_provision"}) == (None, "provision_not_in_force")
    assert amend.applied(None, {"kind": "insert_provision", "new_text": "A raft waits."}) == ("A raft waits.", None)


@pytest.mark.parametrize(
    ("source", "needle", "found"),
    [
        ("boats, boatsman, boats", "boats", [(0, 5), (17, 22)]), ("a long\n   raft (long raft)", "long raft", [(2, 14), (16, 25)]), ("नाव यहाँ रुके", "नाव", [(0, 3)]), ("l'été dû", "été", [(2, 5)]), ("x-1 1-x", "1", [(2, 3), (4, 5)]),
        ("aa aa aa", "aa aa", [(0, 5)]), ("(raft)", "(raft)", [(0, 6)]), ("raft", " ", []), ("", "raft", []),
    ],
)
def test_places_of_words(source, needle, found):
    assert amend.places(source, needle) == found


@given(st.text("ab ,\n", max_size=30), st.text("ab ,", max_size=4))
def test_places_against_every_position(source, needle):
    """Every start is tried; a match may not begin inside the one before."""
    words, want, last = needle.split(), [], 0
    for a in range(len(source)):
        at, ok = a, bool(words) and a >= last
        for k, w in enumerate(words):
            gap = len(source[at:]) - len(source[at:].lstrip()) if k else 0
            ok = ok and (not k or gap > 0) and source.startswith(w, at + gap)
            at += gap + len(w)
        whole = ok and not (source[a].isalnum() and a and source[a - 1].isalnum()) and not (source[at - 1].isalnum() and at < len(source) and source[at].isalnum())
        if whole:
            want.append((a, at))
            last = at
    assert amend.places(source, needle) == want


def swap(who, day, old, new):
    return amend.Step(day, (), who, {"kind": "substitute_words", "old_text": old, "new_text": new})


def test_replay_keeps_versions_and_notes_failures():
    steps = [swap("too early", date(2010, 5, 1), "nine", "x"), swap("no such words", date(2011, 1, 1), "oars", "x"), swap("first", date(2012, 1, 1), "nine", "six"), swap("second", date(2013, 1, 1), "six", "four"), amend.Step(date(2014, 1, 1), (), "gone", {"kind": "omit_provision"}), amend.Step(date(2016, 1, 1), (), "again", {"kind": "insert_provision", "new_text": "Free."})]
    got = list(amend.replay("pays nine", date(2010, 5, 1), steps))
    versions = [(v.valid_from.year, v.valid_to and v.valid_to.year, v.text, v.amendment_id) for v in got if isinstance(v, amend.Version)]
    assert versions == [(2010, 2012, "pays nine", None), (2012, 2013, "pays six", "first"), (2013, 2014, "pays four", "second"), (2016, None, "Free.", "again")]
    assert [v for v in got if not isinstance(v, amend.Version)] == [("too early", "before_baseline"), ("no such words", "old_text_not_found")]


def test_a_day_makes_one_version():
    day = date(2012, 1, 1)
    got = list(amend.replay("pays nine", date(2010, 1, 1), [swap("a", day, "nine", "six"), swap("b", day, "six", "four"), swap("c", day, "oars", "x")]))
    assert [(v[2], v[3]) for v in got if isinstance(v, amend.Version)] == [("pays nine", None), ("pays four", "b")]
    assert list(amend.replay(None, None, [amend.Step(day, (), "in", {"kind": "insert_provision", "new_text": "x"}), amend.Step(day, (), "out", {"kind": "omit_provision"})])) == []


def test_replay_and_consolidation_in_spark(spark):
    base = spark.createDataFrame([(1, "pays nine", date(2010, 1, 1)), (2, "waits", date(2010, 1, 1))], "provision_id long, base_text string, base_from date")
    steps = spark.createDataFrame([(1, "b", date(2013, 1, 1), "six", "four"), (1, "a", date(2012, 1, 1), "nine", "six"), (3, "c", date(2012, 1, 1), "x", "y")], "provision_id long, amendment_id string, effective_from date, old_text string, new_text string")
    steps = steps.selectExpr("*", "'substitute_words' as kind", "cast(null as string) as anchor_text", "cast(null as string) as position", "cast(null as int) as occurrence")
    planned = law.replayed(base, steps)
    assert sorted((r["provision_id"], r["text"] or r["problem"]) for r in planned.collect()) == [(1, "pays four"), (1, "pays nine"), (1, "pays six"), (2, "waits"), (3, "provision_not_in_force")]
    active = planned.where("problem is null and (provision_id = 2 or text = 'pays six')")
    assert {r["provision_id"]: r["action"] for r in law.consolidation(active, planned).collect()} == {1: "replace", 2: "unchanged"}


@pytest.mark.parametrize(
    ("said", "condition", "day", "back"),
    [
        ("These rules come into force on the 9th day of June, 2022.", "on_date", date(2022, 6, 9), False), ("They shall be deemed to have come into force with effect from 02.03.2021.", "on_date", date(2021, 3, 2), True),
        ("This shall take effect on the date of publication in the Official Gazette", "on_gazette", None, False), ("It begins on such date as the Central Government may, by notification, appoint", "on_notification", None, False), ("Nothing is said.", None, None, None),
    ],
)
def test_effect(said, condition, day, back):
    got = dates.effective(said)
    assert (got and (got["condition"], got["effective_from"], got["retrospective"])) == (condition and (condition, day, back))


def test_effect_of_a_clause():
    own, all_ = {"condition": "on_date", "effective_from": date(2020, 1, 1), "phrase": "p", "retrospective": False}, {"condition": "on_notification", "effective_from": None, "phrase": "q", "retrospective": False}
    assert dates.effective_for(own, all_, date(2019, 1, 1))["effective_from"] == date(2020, 1, 1)
    assert dates.effective_for(None, all_, date(2019, 1, 1))["condition"] == "on_notification"
    assert dates.effective_for(None, None, date(2019, 1, 1)) == {"condition": "on_gazette", "effective_from": date(2019, 1, 1), "phrase": None, "retrospective": False}


def test_dates():
    assert [dates.parse_day(x) for x in ("on 31.02.2020", "5th Sept. 2019", "7 / 8", "3-4-2018")] == [None, date(2019, 9, 5), None, date(2018, 4, 3)]
    assert dates.first_dated("1st May, 2020 and dated 2nd May, 2020") == (date(2020, 5, 2), dates.EXACT)
    assert dates.last_dated("dated 2nd May, 2020, dated 03.05.2020, 4.5.2020") == date(2020, 5, 3)


def test_html():
    got = html.blocks("<head><title>t</title><nav>n</nav></head><h2>Boats</h2>One<br>two<hr>three<dl><dt>four<dd>five</dl><table><tr><th>A<th><tr><td><p>1</p><p>2</p><td>3<table><tr><td>deep</table></table>six<table><tr><td>open")
    assert [(b["kind"], b["text"]) for b in got] == [("heading", "Boats"), ("para", "One two"), ("para", "three"), ("para", "four"), ("para", "five"), ("table", "A | \n1 2 | 3deep"), ("table_row", "A: 1 2; Column 2: 3deep"), ("para", "six"), ("table", "open")]
    assert html.decoded(b'<meta charset="iso-8859-1">\xe9')[-1] == "é" and html.decoded(b'<meta charset="none such">x')[-1] == "x"


@pytest.mark.parametrize(("old", "new", "diff"), [("a b c", "a x c", "a [-b-]{+x+} c"), ("a", "a", "a"), ("", "x y", "{+x y+}"), ("x", "", "[-x-]"), ("a b", "a b c", "a b{+c+}")])
def test_word_diff(old, new, diff):
    assert text.marked_diff(old, new) == diff


def test_normal_forms_and_hashes():
    assert text.plain("“a”–b\t\n ﬂ") == '"a"-b fl'
    assert text.simhash("boats  pay TOLLS here") == text.simhash("Boats pay tolls here") != text.simhash("rafts wait for boats")
    assert text.simhash("...") == 0


def test_queries_as_people_type_them():
    places = {t: p for t, p, _ in lexemes.postings(None, "long boats pay a toll on the canal", False)}
    ask = lambda q: lexemes.matches(lexemes.parsed(q, False), places)
    assert [ask(q) for q in ("boats toll", '"boats pay"', '"pay boats"', "raft OR canal", "boats -canal", "boats -raft", '-"boats pay"', "", "OR", '"long boats')] == [True, True, False, True, False, True, False, False, False, True]
    assert lexemes.parsed("the of") == []


def test_stems_weights_and_snippets():
    assert {lexemes.stem(w) for w in ("taxes", "taxing", "taxed", "tax")} == {"tax"}
    query = lexemes.parsed("boat toll")
    near = {t: (p, w) for t, p, w in lexemes.postings(None, "boats: tolls")}
    far = {t: (p, w) for t, p, w in lexemes.postings(None, "boats here and there and much later tolls")}
    head = {t: (p, w) for t, p, w in lexemes.postings("Boat tolls", "x")}
    rank = lambda own: lexemes.cover_density(query, {t: p for t, (p, _) in own.items()}, {t: w for t, (_, w) in own.items()})
    assert rank(head) == 1.0 and rank(near) == pytest.approx(0.4) and rank(far) == pytest.approx(0.4 / 7)
    assert lexemes.snippet(query, "one two boats three tolls", most=3, least=1) == "<mark>boats</mark> three <mark>tolls</mark>"
    assert lexemes.snippet(query, "x" * 300) == "x" * 200


@pytest.mark.parametrize(
    ("said", "default", "found"),
    [
        ("section 16(2) of the CGST Act and rule 36 of the IGST Rules", None, ["prov:CGST_ACT:s16.2", "prov:IGST_RULES:r36"]),
        ("s.16 and s.17 CGST", None, ["prov:CGST_ACT:s16", "prov:CGST_ACT:s17"]),
        ("the CGST Act, and then section 9", None, [None]),
        ("the CGST Act, and then section 9", "IGST_ACT", ["prov:IGST_ACT:s9"]),
        ("rule 4 of the rules that the parties to the matter had agreed on, IGST", "CGST_ACT", ["prov:CGST_RULES:r4"]),
        ("Notification No. 12/2017-Compensation Cess (Rate)", None, ["ntf:COMP(R):12/2017"]),
        ("Notification No. 12/2017-Compensation Cess dated today", None, ["ntf:COMP:12/2017"]),
        ("Circ. No. 183/15/2022 and Notif 3/2019-ut(r)", None, ["ntf:UT(R):3/2019", "cir:183/15/2022"]),
    ],
)
def test_each_provision_has_its_own_instrument(said, default, found):
    assert [c["canonical_id"] for c in legal.citations(said, default)] == found


def test_candidates_of_provisions_without_instrument():
    found = legal.citations("section 9 and rule 2(b)")
    assert [c["candidates"] for c in found] == [["prov:CGST_ACT:s9", "prov:IGST_ACT:s9", "prov:UTGST_ACT:s9"], ["prov:CGST_RULES:r2.b", "prov:IGST_RULES:r2.b", "prov:UTGST_RULES:r2.b"]]
    assert [c["confidence"] for c in found] == [0.6, 0.6]
