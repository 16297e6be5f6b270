"""the index is built from texts that are dealt by their blocks, a query's blocks are ranked in arrays, and chunks are stored once."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import term_index
from lexloom.plans import find
from lexloom.sources import snapshots

from .test_search_index import best, chunks_of, scanned


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_f9_no_word_is_shuffled(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(snapshots, "publish", lambda spark, root, tables, *_: seen.update(tables))
    term_index.add(spark, f"{tmp_path}/i", chunks_of(spark, 50, 10, 1))
    plan = plan_of(seen["postings"])
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("english", [True, False])
def test_f9_blocks_in_several_pieces(spark, tmp_path, monkeypatch, english):
    """Three chunks a batch, so all blocks come in pieces; a chunk in many rows, chunks without words, without text and without document."""
    for name, value in (("BLOCK", 40), ("FIRST", 2), ("WRITER", 2)):
        monkeypatch.setattr(term_index, name, value)
    texts = [(7, "raft boat toll"), (7, "boat"), *[(9, "due " * k) for k in range(8)], (10, ""), (11, None), (12, "... !"), (13, "of the boat"), (14, "BOATS Straße toll"), (15, "boat of toll"), (16, "pay " * 400 + "boat toll")]
    odd = spark.createDataFrame([(10_000 + k, None if k == 16 else 5000 + k, None if k % 2 else "lock gate", text) for k, text in texts], "chunk_id long, doc_id long, heading string, text string")
    chunks = chunks_of(spark, 200, 120, 2).select(*odd.columns).unionByName(odd).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        term_index.add(spark, f"{tmp_path}/i", chunks, english)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    reader = term_index.Reader(spark, f"{tmp_path}/i")
    rows = reader.blocks(["boat"])
    assert rows.count() > rows.select("block").distinct().count() > 1
    for query, most in [("boats toll", 4), ('"of the" OR due', 1000), ("pay -boat -raft", 1000), ('"gate boat" OR straße', 1000)]:
        assert best(reader, query, most) == scanned(chunks, query, most, english), query


def test_f9_chunks_are_made_without_a_join(spark, tmp_path):
    spark.createDataFrame([(1, "a\n\n b "), (2, None), (3, " "), (None, "x"), (4, "c")], "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    made = find._chunks(spark, str(tmp_path))
    assert "Join" not in plan_of(made)
    assert [(r.chunk_id, r.doc_id, r.seq, r.text, r.heading) for r in made.orderBy("chunk_id").collect()] == [(1_000_000, 1, 0, "a", "rules"), (1_000_001, 1, 1, "b", "rules"), (4_000_000, 4, 0, "c", "order")]
    _, stored = find._indexed(spark, str(tmp_path), english=False)
    assert stored.dtypes == made.dtypes and "documents.parquet" not in "".join(stored.inputFiles())
    assert sorted(stored.collect(), key=str) == sorted(made.collect(), key=str)
