"""Operators that the queries touch lightly: layout, files, workflow, writes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lexloom.operators import dedup, folds, layout, relations, search, workflow, writes
from lexloom.sources import files


def test_keys_and_types(spark):
    rows = spark.createDataFrame([("a/b", True), ("/a", False), ("a//b", False), ("a/../b", False), ("a\\b", False), ("", False), ("..a/b", True)], "k string, ok boolean")
    assert all(r["ok"] == r["got"] for r in rows.withColumn("got", files.valid_key(F.col("k"))).collect())
    page = spark.createDataFrame([(bytearray(b"  <!-- x --><!DOCTYPE html>"),), (bytearray(b"%PDF-1.4"),), (bytearray(b"plain"),)], "c binary")
    assert [r[0] for r in page.select(files.mime(F.col("c"))).collect()] == ["text/html", "application/pdf", None]


def test_files_are_written_once(spark, tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / "in" / "src" / "act"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.html").write_text("<html>same</html>")
    got = files.binary_files(spark, f"{tmp_path}/in")
    assert {(r["source"], r["doc_type"], r["mime"]) for r in got.collect()} == {("src", "act", "text/html")}
    files.write_once(got, f"{tmp_path}/raw")
    files.write_once(got, f"{tmp_path}/raw")
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 1


def line(page, n, top, text, bottom=None):
    return (page, 0, n, float(top), float(bottom or top + 10), 800.0, text)


def test_paragraphs_and_margins(spark):
    rows = [line(p, n, t, x) for p in range(4) for n, t, x in ((1, 5, f"Page {p}"), (2, 100, "one two"), (3, 112, "three"), (4, 200, "four"), (5, 212, "1. five"))]
    df = spark.createDataFrame(rows, "page int, column int, line int, top double, bottom double, height double, text string")
    texts = [r["text"] for r in layout.paragraphs(df).where("page = 0").orderBy("para").collect()]
    assert texts == ["Page 0", "one two three", "four", "1. five"]
    votes = df.withColumn("doc", F.lit(1)).unionByName(df.withColumn("doc", F.lit(2)).withColumn("text", F.concat("text", F.when(F.col("page") > 1, "!").otherwise(""))))
    assert [(r["doc"], r["key"], r["pages"]) for r in layout.repeated_margins(votes).collect()] == [(1, "top:page #", 4)]


def test_lines_keep_to_their_first_word(spark):
    """Words that drift down by less than the gap each are lines of their own once they are too far from the first."""
    rows = [(1, 10.0 * k, 10.0 * k + 8, 100.0 + 2 * k, 110.0, f"w{k}", 600.0, 800.0) for k in range(4)]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double, top double, bottom double, text string, width double, height double")
    assert [(r["line"], r["text"]) for r in layout.lines(df).orderBy("line").collect()] == [(1, "w0 w1"), (2, "w2 w3")]


def test_upright(spark):
    assert layout.upright(spark.createDataFrame([(0.0, 0.0), (0.5, 0.5)], "m1 double, m2 double")).count() == 1


def test_retrieval_scores(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, doc string, place int")
    wanted = spark.createDataFrame([(1, "b"), (1, "c"), (2, "z")], "query int, doc string")
    assert {r["query"]: (r["recall"], r["reciprocal"]) for r in workflow.retrieval_scores(hits, wanted, 2).collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0)}


def test_ranks_and_round_robin(spark):
    tasks = spark.range(0, 1000, 7).withColumnRenamed("id", "t")
    assert [r["rank"] for r in writes.ranks(tasks, "t").orderBy("t").collect()] == list(range(143))
    editors = spark.createDataFrame([(5,), (9,)], "e long")
    assert [r["e"] for r in writes.round_robin(tasks, "t", editors, "e").orderBy("t").limit(4).collect()] == [5, 9, 5, 9]


def test_merged_versions_and_urls(spark):
    mapping = spark.createDataFrame([(2, 1)], "doc long, target long")
    urls = spark.createDataFrame([(1, "u", 3, 4), (2, "u", 1, 9)], "doc long, url string, first_seen int, last_seen int")
    assert [tuple(r) for r in writes.merged_urls(urls, mapping, "doc").collect()] == [(1, "u", 1, 9)]
    versions = spark.createDataFrame([(1, 10), (2, 20), (3, 5)], "doc long, at int")
    assert {(r["doc"], r["target"], r["version_no"]) for r in writes.merged_versions(versions, mapping, "doc", "at").collect()} == {(1, 1, 1), (2, 1, 2), (3, 3, 1)}


def test_near_pairs_lose_none(spark):
    import random

    rnd = random.Random(7)
    base = [rnd.getrandbits(63) for _ in range(20)]
    hashes = [(k, 0, base[k % 20] ^ sum(1 << b for b in rnd.sample(range(63), k // 20))) for k in range(100)]
    got = {(r["a"], r["b"]) for r in dedup.near_pairs(spark.createDataFrame(hashes, "doc_id long, block int, simhash long"), "block").collect()}
    want = {(a, b) for a, _, x in hashes for b, _, y in hashes if a < b and (x ^ y).bit_count() <= 3}
    assert got == want


def test_page_after_starts_at_the_beginning(spark):
    df = spark.range(5)
    assert [r["id"] for r in relations.page_after(df, {"id": None}, 2).collect()] == [0, 1, 2]


def test_merge_targets_look_at_every_near_document(spark):
    """Copies share a number that their class's least document lacks; so do members of near classes."""
    rows = [(3, 0, 5, 1), (6, 0, 5, 0), (12, 0, 5, 0), (13, 0, 5 ^ 7, 0), (14, 0, 5 ^ 7, 2), (15, 0, 5 ^ 63, 2), (16, 1, 5, 0), (17, 0, 5, None), (18, 0, 5, None), (1, 0, 5 ^ 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, block int, simhash long, number int")
    got = {r["doc_id"]: r["target"] for r in dedup.merge_targets(df.select("doc_id", "block", "simhash"), df.select("doc_id", "number"), "block", "number").collect()}
    near = lambda x, y: x[1] == y[1] and (x[2] ^ y[2]).bit_count() <= 3 and x[3] is not None and x[3] == y[3]
    want = {y[0]: min(x[0] for x in rows if x[0] < y[0] and near(x, y)) for y in rows if any(x[0] < y[0] and near(x, y) for x in rows)}
    assert got == want and got[12] == 6 and got[13] == 6 and got[15] == 14


def test_near_dupes_pair_documents_whatever_their_ids(spark, tmp_path):
    from lexloom.plans import texts

    words = " ".join(f"word{k} of{k % 7}" for k in range(80))
    spark.createDataFrame([(1, words), (2, words), (6, words), (9, "something else altogether, with other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["a"], r["b"]) for r in texts.near_dupes(spark, str(tmp_path)).collect()} == {(1, 2), (1, 6)}


def test_hashed_bits_gather_no_documents(spark):
    rows = [(k, "one shared text") for k in range(50)] + [(90, None), (91, ""), (92, "another"), (None, "another"), (92, "another")]
    got = dedup.hashed_bits(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = [tuple(r) for r in got.collect()]
    assert sorted(str(i) for i, _ in found) == sorted(str(i) for i, _ in rows)
    assert len({h for i, h in found if i is not None and i < 50}) == 1 and {h for i, h in found if i in (90, 91)} == {0}


def test_trees_of_any_depth(spark):
    """A chain of 40, two roots, an orphan and a circle."""
    chain = [(f"n{k}", f"n{k - 1}" if k else None, k) for k in range(40)]
    nodes = spark.createDataFrame([*chain, ("r", None, 7), ("o", "nobody", 1), ("c1", "c2", 1), ("c2", "c1", 1)], "id string, parent_id string, ordinal long")
    got = {r["id"]: (r["depth"], r["sort_key"]) for r in relations.tree_order(nodes).collect()}
    assert set(got) == {f"n{k}" for k in range(40)} | {"r"}
    assert got["n39"] == (39, ".".join(f"{k:010}" for k in range(40)))
    assert relations.tree_order(nodes.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("raw", "rank", "status", "kind", "days", "court", "state", "score"),
    [
        (1.0, 2, "in_force", "act", 10, None, None, 1.25), (0.0, 0, None, "memo", None, None, None, 0.1 * 1.12), (None, None, "amended", "act", None, None, None, 0.1 * 1.12), (1.0, 8, "stayed", "circular", 1095, None, None, 0.7 * 1.05), (1.0, 8, "Rescinded", "order", 1096, None, None, 0.5),
        (1.0, 6, "withdrawn", "judgement", -1, "HC", "ka", 1.08 * 1.15 * 0.7), (1.0, 6, "in_force", "judgement", 0, "HC", None, 1.08 * 0.95 * 1.05), (1.0, 3, "superseded", "judgement", 0, "SC", "KA", 1.2 * 1.05 * 0.5), (1.0, 99, "in_force", "act", 5, None, None, 1.0),
    ],
)
def test_scores(spark, raw, rank, status, kind, days, court, state, score):
    rows = spark.createDataFrame([(raw, rank, status, kind, days, court, state)], "raw double, rank int, status string, kind string, days int, court string, state string")
    on = F.lit("2022-01-01").cast("date")
    got = rows.select(search.adjusted(F.col("raw"), F.col("rank"), F.col("status"), F.col("kind"), F.date_sub(on, F.col("days")), on, F.col("court"), F.col("state"), F.lit("KA"))).first()[0]
    assert got == pytest.approx(score)


@pytest.mark.parametrize(("status", "action", "after", "outcome"), [("open", "edit_approve", "done", "ok"), ("open", "needs_info", "in_review", "ok"), ("in_review", "needs_info", "in_review", "ok"), ("in_review", "reject", "rejected", "ok"), ("done", "approve", "done", "conflict"), ("rejected", "needs_info", "rejected", "conflict"), ("open", "start", "open", "conflict")])
def test_decisions(spark, status, action, after, outcome):
    things = spark.createDataFrame([(1, status)], "k int, status string")
    asked = spark.createDataFrame([(1, action)], "k int, action string")
    assert [tuple(r) for r in workflow.decided(things, asked, "k").select("status", "outcome").collect()] == [(after, outcome)]


def test_status_may_not_begin_before_the_open_one(spark):
    stored = spark.createDataFrame([(1, "in_force", date(2020, 1, 1), None), (2, "in_force", date(2020, 1, 1), None)], "k int, status string, valid_from date, valid_to date")
    changes = spark.createDataFrame([(1, "stayed", date(2021, 1, 1)), (2, "stayed", date(2019, 1, 1)), (3, "in_force", date(2019, 1, 1))], "k int, status string, valid_from date")
    history, rejected = writes.set_status(stored, changes, "k")
    assert sorted((r["k"], r["status"], r["valid_to"]) for r in history.collect() if r["valid_to"]) == [(1, "in_force", date(2021, 1, 1))]
    assert history.count() == 4 and [r["k"] for r in rejected.collect()] == [2]


def test_folds_stream_a_key_in_order(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (-F.col("id")).alias("at"))
    got = folds.folded(rows, ["k"], ["at"], lambda key, own: [(key[0], sum(1 for _ in own))], "k long, n long").collect()
    assert {r["k"]: r["n"] for r in got} == {0: 1667, 1: 1667, 2: 1666}
    first = folds.folded(rows, ["k"], ["at"], lambda key, own: [(key[0], next(own)[1])], "k long, at long").collect()
    assert {r["k"]: r["at"] for r in first} == {0: -4998, 1: -4999, 2: -4997}


def test_search_from_index_to_page(spark):
    rows = [("c1", 1, "boats pay a toll", "act", 2, "in_force", None), ("c2", 1, "a toll on boats and rafts, and boats", "act", 2, "in_force", None), ("c3", 2, "boats and no dues", "circular", 8, "stayed", date(2021, 6, 1)), ("c4", 3, "boats pay a toll", "act", 2, "in_force", date(2023, 1, 1)), ("c5", 4, "rafts wait", "judgement", 6, "in_force", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id int, text string, doc_type string, authority_rank int, status string, valid_from date").selectExpr("*", "cast(null as date) valid_to", "cast(null as string) court_level", "cast(null as string) state_code")
    index = search.postings(chunks, "chunk_id", english=True)
    items, groups = search.search(index, chunks, "boats -dues", F.lit("2022-01-01").cast("date"))
    assert [(r["doc_id"], r["chunk_id"], r["passages"]) for r in items.collect()] == [(1, "c2", 2)]
    assert "<mark>boats</mark>" in items.first()["snippet"]
    assert {r["bucket"]: r["n"] for r in groups.collect()} == {"provisions": 1, "notifications": 0, "circulars": 0, "judgements": 0}
    some, _ = search.search(index, chunks, "boats OR rafts", F.lit("2022-01-01").cast("date"), doc_types=["circular", "judgement"])
    assert sorted(r["doc_id"] for r in some.collect()) == [2, 4]


def test_watched_folders_and_stores(spark, tmp_path):
    from lexloom.streaming import jobs

    for name in ("one", "two"):
        folder = tmp_path / "in" / "gazette" / "act"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.html").write_text(f"<html>{name}</html>")
    got = jobs.drained(files.watched(spark, f"{tmp_path}/in"), "watched_files", "append")
    assert sorted((r["source"], r["doc_type"], r["mime"], r["length"]) for r in got.collect()) == [("gazette", "act", "text/html", 16)] * 2
    assert [r["key"] for r in files.stored(spark, f"{tmp_path}/in", "gazette").collect()] == ["gazette/act/one.html", "gazette/act/two.html"]


def test_overwriting_some_keys_leaves_the_others(spark, tmp_path):
    rows = lambda *ks: spark.createDataFrame([(k, v) for k, v in ks], "k int, v string")
    writes.overwrite(rows((1, "a"), (1, "b"), (2, "c")), f"{tmp_path}/t", "k")
    writes.overwrite(rows((1, "d")), f"{tmp_path}/t", "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "d"), (2, "c")]


def test_canonical_json():
    assert writes.canonical_json({"b": 1, "a": None, "é": date(2020, 1, 1)}) == '{"a":null,"b":1,"é":"2020-01-01"}'
