"""Every operator on awkward rows and on an empty table: one result a row, none lost, and the promised columns."""

import pytest

import corpus_pipeline
from lexloom.llm import decontaminate, langid, ngram_join, packing, pii, quality, runs, spotsigs, suffix_dedup, token_counts, toxicity, wavelet


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(i, 1 if i % 2 else 0, 1 if i % 3 == 0 else 0) for i in range(1, 15)] + [(2, None, None)], "doc_id long, quality int, toxic int")


def bench(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, "seven wizards quietly mix bright potions near the old river bank"), (2, None), (3, ""), (4, "no such words"), (None, "lazy dog")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d, e: toxicity.report(d, labels(s, e)),
    "pii": lambda s, d, e: pii.digest(d),
    "langid": lambda s, d, e: langid.report(d),
    "quality": lambda s, d, e: quality.report(d, labels(s, e)),
    "decontaminate": lambda s, d, e: decontaminate.report(d, bench(s, e)),
    "spotsigs": lambda s, d, e: spotsigs.report(d),
    "ngram_join": lambda s, d, e: ngram_join.report(d),
    "wavelet": lambda s, d, e: wavelet.round_trip(d),
    "suffix_dedup": lambda s, d, e: suffix_dedup.report(d),
    "token_counts": lambda s, d, e: token_counts.report(d),
    "runs": lambda s, d, e: runs.report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_a_row(spark, docs, nothing, name):
    got = OPERATORS[name](spark, docs, False)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert OPERATORS[name](spark, nothing, False).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontaminate"])
def test_without_labels_or_items(spark, docs, name):
    got = OPERATORS[name](spark, docs, True)
    assert got.count() == docs.count()
    if "score" in got.columns:
        assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_filters_keep_columns(spark, docs, nothing):
    b = bench(spark)
    for f in (langid.keep_known, lambda d: ngram_join.keep_one(d, 5, 80), lambda d: decontaminate.drop_contaminated(d, b), pii.redact, suffix_dedup.remove):
        for table in (docs, nothing):
            got = f(table)
            assert got.columns == docs.columns
            got.collect()


def test_packing_places_every_piece(spark, docs, nothing):
    got = packing.pack(docs).toPandas()
    assert len(got) == docs.count()
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert packing.pack(nothing).count() == 0


def test_pipeline(spark, docs, nothing, tmp_path):
    for k, table in enumerate((docs, nothing)):
        table.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        bench(spark).write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)
        ids = {r["doc_id"] for r in got.collect()}
        # no language: 4-7; copies of 1: 2, 3, 14 (the same shingles); benchmark: 1 and the null id
        assert ids == ({8, 9, 10, 11, 12, 13} if k == 0 else set())
