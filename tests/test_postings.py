"""Postings of texts that are dealt by their ids."""

from lexloom.plans import texts


def test_no_word_is_shuffled_and_rows_of_one_id_are_one_text(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (1, "b"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.postings(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 2, 0), ("b", 1, 2, 0)}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 1
