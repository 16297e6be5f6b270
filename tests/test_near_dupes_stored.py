"""Hashes of near duplicates are computed once."""

from lexloom.plans import texts


def test_no_text_is_hashed_again_in_the_join(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.near_dupes(spark, str(tmp_path))
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 2, 0)]
