"""The stored index against postings that are not stored, and English stems against published ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.stemmer import stem
from lexloom.operators import search, term_index
from lexloom.sources import snapshots

WORDS = "boat toll canal raft pay due wait lock gate barge boats tolled locking the of".split()
FACTS = "doc_type string, authority_rank int, status string, valid_from date, valid_to date, court_level string, state_code string"


def chunks_of(spark, n, docs, seed, first=0):
    rnd = random.Random(seed)
    rows = [(first + k, rnd.randrange(docs), rnd.choice(WORDS), " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(30))), rnd.choice(["act", "circular", "judgement"]), rnd.randrange(12), "in_force", None, None, None, None) for k in range(n)]
    return spark.createDataFrame(rows, f"chunk_id long, doc_id long, heading string, text string, {FACTS}")


QUERIES = ["boat", "boats toll", '"boat toll"', "raft OR canal -gate", "pay -boat -raft", '"lock gate" OR barge wait', "the", "nowhere", "boat nowhere", "tolling OR nowhere", "due due due", "-boat"]


def scanned(chunks, query, most, english=True):
    found = search.found(search.postings(chunks, "chunk_id", english), "chunk_id", query, english)
    return [(r["chunk_id"], round(r["raw_rank"], 9)) for r in found.orderBy(F.desc("raw_rank"), "chunk_id").limit(most).collect()]


def best(reader, query, most):
    return [(r["chunk_id"], round(r["raw_rank"], 9)) for r in reader.best(query, most).orderBy(F.desc("raw_rank"), "chunk_id").collect()]


def test_hits_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    """Few chunks a block and few blocks at first, so that most blocks are skipped or opened later."""
    for name, value in (("BLOCK", 20), ("FIRST", 3), ("WRITER", 4)):
        monkeypatch.setattr(term_index, name, value)
    chunks = chunks_of(spark, 600, 120, 1).cache()
    term_index.add(spark, f"{tmp_path}/i", chunks)
    reader = term_index.Reader(spark, f"{tmp_path}/i")
    for query in QUERIES:
        for most in (5, 1000):
            assert best(reader, query, most) == scanned(chunks, query, most), query


def test_bounds_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", 20)
    chunks = chunks_of(spark, 400, 50, 2)
    term_index.add(spark, f"{tmp_path}/i", chunks)
    reader = term_index.Reader(spark, f"{tmp_path}/i")
    for query in ("boat", "boat toll", "boat toll canal", "raft OR boat toll pay"):
        blocks = reader.blocks(term_index.lexemes.terms_of(term_index.lexemes.parsed(query)))
        bound = {r["block"]: r["bound"] for r in reader.bounds(blocks, query).collect()}
        place = F.pmod(F.xxhash64("chunk_id"), F.lit(20)).alias("block")
        got = reader.hits(blocks, query).select(place, "raw_rank").collect()
        assert got and all(r["raw_rank"] <= bound[r["block"]] + 1e-9 for r in got)


def test_a_later_batch_takes_the_place_of_documents(spark, tmp_path):
    old, new = chunks_of(spark, 200, 40, 3), chunks_of(spark, 60, 20, 4, first=1000)
    term_index.add(spark, f"{tmp_path}/i", old)
    early = term_index.Reader(spark, f"{tmp_path}/i")
    before = best(early, "boats", 1000)
    term_index.add(spark, f"{tmp_path}/i", new)
    held = [r["doc_id"] for r in new.select("doc_id").distinct().collect()]
    now = old.where(~F.col("doc_id").isin(held)).unionByName(new)
    reader = term_index.Reader(spark, f"{tmp_path}/i")
    for query in QUERIES:
        assert best(reader, query, 1000) == scanned(now, query, 1000), query
    assert best(early, "boats", 1000) == before == scanned(old, "boats", 1000)  # who began earlier reads what was there


def test_only_files_of_the_query_s_terms_are_read(spark, tmp_path):
    term_index.add(spark, f"{tmp_path}/i", chunks_of(spark, 200, 40, 5))
    reader = term_index.Reader(spark, f"{tmp_path}/i")
    asked = reader.blocks(["boat"])
    asked.collect()
    scans = [line for line in asked._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert scans and "bucket" in scans[0]
    buckets = {f.split("bucket=")[1].split("/")[0] for f in reader.postings.inputFiles()}
    here = {str(r["bucket"]) for r in asked.select("bucket").distinct().collect()}
    assert len(here) == 1 < len(buckets)


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    root = f"{tmp_path}/i"
    term_index.add(spark, root, chunks_of(spark, 50, 10, 6))
    want = best(term_index.Reader(spark, root), "boat", 100)

    def dies(*_):
        raise RuntimeError("the driver is gone")

    real, snapshots.batches = snapshots.batches, dies  # the tables are written, the manifest is not
    try:
        with pytest.raises(RuntimeError):
            term_index.add(spark, root, chunks_of(spark, 50, 10, 7))
    finally:
        snapshots.batches = real
    assert best(term_index.Reader(spark, root), "boat", 100) == want
    assert best(term_index.Reader(spark, f"{tmp_path}/none"), "boat", 100) == []


def test_an_empty_batch(spark, tmp_path):
    term_index.add(spark, f"{tmp_path}/i", chunks_of(spark, 0, 1, 8))
    assert best(term_index.Reader(spark, f"{tmp_path}/i"), "boat", 10) == []


def test_tables_of_a_version_change_at_once(spark, tmp_path):
    root = f"{tmp_path}/s"
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "version_id long")
    rows = lambda text, *ids: spark.createDataFrame([(i, text) for i in ids], "version_id long, text string")
    state = lambda known, name: sorted((r["version_id"], r["text"]) for r in snapshots.current(spark, known, name, "version_id").collect())
    snapshots.rewrite(spark, root, "version_id", keys(1, 2), {"pages": rows("p0", 1, 2), "blocks": rows("b0", 1, 1, 2)})
    early = snapshots.batches(spark, root)
    snapshots.rewrite(spark, root, "version_id", keys(1), {"pages": rows("p1", 1), "blocks": rows("b1", *[])})
    late = snapshots.batches(spark, root)
    assert state(early, "pages") == [(1, "p0"), (2, "p0")] and state(early, "blocks") == [(1, "b0"), (1, "b0"), (2, "b0")]
    assert state(late, "pages") == [(1, "p1"), (2, "p0")] and state(late, "blocks") == [(2, "b0")]


#: Samples of the algorithm's published vocabulary and rules, word and stem.
PUBLISHED = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consistency consist|consistently consist|consolation consol|consolatory consolatori|consolidate consolid
consoling consol|consolingly consol|consonant conson|conspicuously conspicu|conspiracy conspiraci|conspirators conspir|constables constabl|constancy constanc|knack knack|knackeries knackeri|knaves knave|knavish knavish
kneading knead|kneeled kneel|knees knee|knelt knelt|knightly knight|knitted knit|knives knive|knockers knocker|knots knot|taxation taxat|taxes tax|generalizations general|generate generat|generic generic
communication communic|flies fli|dying die|skies sky|news news|happy happi|say say|by by|cries cri|ties tie|gas gas|gaps gap|kiwis kiwi|hoping hope|hopping hop|luxuriating luxuri|exceeding exceed|agreed agre|feed feed
relational relat|rational ration|hopefulness hope|formaliti formal|sensibiliti sensibl|analogi analog|triplicate triplic|electrical electr|goodness good|adoption adopt|probate probat|falling fall|youth youth|herrings herring
singly singl|idly idl|only onli|boy's boy|'tis tis|über über|x1 x1""".replace("\n", "|").split("|")


@pytest.mark.parametrize("pair", PUBLISHED)
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want
