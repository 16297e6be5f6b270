"""Rows are dealt to as many tasks as they need, whatever the files they come from."""

import pytest
from pyspark.sql import functions as F

from lexloom import session
from lexloom.functions import legal, sql
from lexloom.functions.text import normalise_text
from lexloom.operators import amendments, fields, relations
from lexloom.plans import find, lookups
from lexloom.session import dealt


def test_a_small_file_goes_to_all_tasks_and_a_large_table_to_more(spark):
    rows = spark.range(1000, numPartitions=1)
    assert dealt(rows).rdd.getNumPartitions() == 4
    keyed = dealt(rows, "id", rows=100)
    assert keyed.rdd.getNumPartitions() == 10
    assert keyed.groupBy("id").count().count() == 1000


def test_f13_python_of_a_table_in_one_file_runs_in_more_than_one_task(spark, tmp_path):
    part = spark.range(4000, numPartitions=1).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = find.sql_functions(spark, str(tmp_path))
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    assert got.count() == 4000
    sql.register(spark)


@pytest.mark.parametrize(("said", "code"), [("Central Tax (Rate) dated", "CT(R)"), ("ct", "CT"), ("integrated", "IT"), ("x", None), ("", None), ("central tax ct(r)", "CT")])
def test_series(said, code):
    assert legal.series_of(said) == code


def test_f19_texts_with_nulls(spark):
    rows = spark.createDataFrame([(1, " a  b "), (2, None), (3, ""), (4, "x – y")], "k int, text string")
    got = {r.k: r.t for r in rows.select("k", normalise_text("text").alias("t")).collect()}
    assert got == {1: "a b", 2: None, 3: "", 4: "x - y"}


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_f12_units_are_gathered_once(spark, capsys):
    blocks = spark.createDataFrame([(1, 0, "(a) rule 2 shall be omitted;")], "d long, seq int, text string")
    plan = plan_of(amendments.detected(blocks, "d"), capsys)
    assert sum("ObjectHashAggregate" in line and "collect_list" in line for line in plan.splitlines()) == 2  # a part before the shuffle, a part behind it


def test_f15_f10_blocks_are_dealt_by_their_rows(spark, capsys, monkeypatch):
    blocks = spark.createDataFrame([(k, 0, "ORDER No. 1/2019") for k in range(90)], "d long, seq int, text string")
    docs = spark.createDataFrame([(1, "order", None, None)], "d long, doc_type string, title string, file_name string")
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.shares(blocks) == 9
    assert "hashpartitioning(d#" in (plan := plan_of(amendments.detected(blocks, "d"), capsys)) and ", 9), REPARTITION_BY_NUM" in plan
    assert ", 9), REPARTITION_BY_NUM" in plan_of(fields.fields(blocks, docs, "d", F.current_date()), capsys)


def test_f25_lines_are_dealt_by_their_rows(spark, capsys, monkeypatch, tmp_path):
    lines = spark.range(100).select((F.col("id") % 9).alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"), F.lit("2020-01-01").cast("date").alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(lookups, "LINES", 10)
    got = lookups.document_sources(spark, str(tmp_path))
    assert plan_of(got, capsys).count(", 10), REPARTITION_BY_NUM") == 3
    assert got.count() == 9


def test_f24_links_are_dealt_by_their_rows(spark, capsys, monkeypatch):
    links = spark.createDataFrame([("provision", 1, 2, "amends")] * 30 + [("provision", 2, 2, "amends"), ("document", 1, 2, "amends")], "dst_type string, src_id long, dst_id long, link_type string")
    docs = spark.createDataFrame([(1, "act"), (2, "act")], "doc_id long, doc_type string")
    monkeypatch.setattr(relations, "LINKS", 4)
    got = relations.linked(links, docs)
    assert ", 8), REPARTITION_BY_NUM" in plan_of(got, capsys)
    assert [tuple(r) for r in got.collect()] == [(2, "amending_instruments", 31, 2)]
