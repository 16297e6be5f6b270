"""Late amendments on record, and results that stay small where pairs or numbers would not."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from lexloom.operators import dedup, law, relations, stages
from lexloom.streaming import jobs, replans

START, DAY = datetime(2024, 1, 1), timedelta(days=1)


def step(provision, amendment, day, old, new):
    return (provision, amendment, date(2020, 1, day), "substitute_words", old, new, None, None, None)


#: Amendments by batch; the second ones come late, between and before those of the first.
BATCHES = [
    [step(1, "a", 5, "one", "two"), step(2, "b", 5, "one", "nine")],
    [step(1, "c", 3, "one", "one and one"), step(1, "d", 8, "two", "three")],
    [step(2, "e", 7, "nine", "ten"), step(3, "f", 2, "absent", "x")],
]


def rows(df):
    return sorted(map(str, df.select("provision_id", "valid_from", "valid_to", "text", "amendment_id").collect()))


def test_each_batch_is_on_record_as_a_full_replay_would_have_it(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    base = spark.createDataFrame([(k, "one boat", date(2020, 1, 1)) for k in (1, 2, 3)], "provision_id long, base_text string, base_from date")
    replans.begin(spark, root, base, START)
    steps = [spark.createDataFrame(b, replans.STEP) for b in BATCHES]
    replans.follow(jobs.in_steps(spark, steps, "amendments"), root, base, START + DAY, DAY, f"{tmp_path}/state")
    record = replans.versions(spark, root).cache()
    so_far = spark.createDataFrame([], replans.STEP)
    for n, batch in enumerate([so_far, *steps]):
        so_far = so_far.unionByName(batch)
        then = F.lit(START + n * DAY + timedelta(hours=1))
        as_recorded = record.where((F.col("rec_from") <= then) & (F.col("rec_to").isNull() | (F.col("rec_to") > then)))
        assert rows(as_recorded) == rows(law.replayed(base, so_far).where("problem is null")), n
    assert {r["provision_id"] for r in record.where("rec_to is not null").collect()} == {1, 2}
    before = rows(record)
    replans.replan(spark, root, base, steps[2], START + 9 * DAY, 2)  # a batch that is run again
    assert rows(replans.versions(spark, root)) == before


def test_late_amendments_append_or_replay(spark):
    known = spark.createDataFrame([(1, date(2020, 1, 5)), (2, date(2020, 1, 5))], "provision_id long, effective_from date")
    late = spark.createDataFrame([(1, date(2020, 1, 6)), (2, date(2020, 1, 5)), (2, date(2020, 1, 9)), (3, date(2020, 1, 1))], known.schema)
    assert {tuple(r) for r in stages.replanned(known, late).collect()} == {(1, "append"), (2, "replay"), (3, "replay")}


def test_a_number_that_all_share_gives_a_row_each(spark):
    docs = spark.range(2000).select(F.lit(1).alias("block"), F.col("id").alias("doc"), F.array(F.lit("x")).alias("numbers"))
    got = dedup.sharing(docs, "block", "doc", "numbers")
    assert got.count() == 2000 and got.where("target <> 0").count() == 0


def test_every_pair_that_shares_a_number_is_told_once(spark):
    docs = spark.createDataFrame([(1, 1, ["x", "y"]), (1, 2, ["x", "y"]), (1, 3, ["y"]), (1, 4, ["z"]), (2, 5, ["x"]), (2, 6, [])], "block long, doc long, numbers array<string>")
    assert sorted(tuple(r) for r in dedup.sharing_pairs(docs, "block", "doc", "numbers").collect()) == [(1, 2), (1, 3), (2, 3)]


def test_a_wide_gap_is_one_range(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 3_000_000), (1, 3, 3_000_002), (1, 4, 3_000_002)], "k long, seq long, number long")
    assert tuple(relations.numbering_gaps(labels, "k", "number").first()) == (1, 1, 3_000_002, 2_999_999, "2-2999999,3000001")
    got = {(r["problem"], r["number"], r["upto"]) for r in relations.numbering_problems(labels, "k", "seq", "number").collect()}
    assert got == {("gap", 2, 2_999_999), ("gap", 3_000_001, 3_000_001), ("duplicate", 3_000_002, 3_000_002)}


def test_every_missing_number_is_told(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 2, 10_000), (1, 3, 10_002), (1, 4, 10_002), (1, 5, 3)], "k long, seq long, number long")
    got = relations.each_number(relations.numbering_problems(labels, "k", "seq", "number"))
    assert got.columns == ["k", "problem", "number"]
    rows = sorted((r["problem"], r["number"]) for r in got.collect())
    assert rows == sorted([("gap", n) for n in (2, *range(4, 10_000), 10_001)] + [("duplicate", 10_002), ("out_of_order", 3)])


def test_a_path_that_very_many_have_and_ask_for(spark):
    """60,000 asks of 60,000 documents of one path: 3.6 thousand million pairs, were they joined before they are ranked."""
    paths = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("s1").alias("path"))
    asked = spark.range(60_000).select(F.col("id").alias("ask"), F.when(F.col("id") % 2 == 0, "s1").otherwise("s2").alias("path"))
    got = relations.first_of_path(asked, paths, "path", "doc_id", 2)
    assert sorted(tuple(r) for r in got.groupBy("doc_id", "place").count().collect()) == [(0, 1, 30_000), (1, 2, 30_000)]
