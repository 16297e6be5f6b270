"""Configuration files and pages with marks, on small tables of our own."""

import pytest

from lexloom.operators import access
from lexloom.sources import settings

FIELDS = [settings.Field("code", "string", unique=True), settings.Field("limits.pages", "int", least=1), settings.Field("share", "double", required=False), settings.Field("names", "array<string>", required=False)]


def checked(spark, *texts):
    files = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, text string")
    rows, violations = settings.checked(files, "courts", FIELDS)
    return sorted(tuple(r) for r in rows.collect()), sorted(tuple(v) for v in violations.collect())


def test_rows_and_violations(spark):
    rows, violations = checked(
        spark,
        '{"courts": [{"code": "A", "limits": {"pages": 3}, "share": 1, "names": []}, {"code": "B", "limits": {"pages": "3"}}, {"code": "C", "limits": {}}, {"code": null, "limits": {"pages": 0}}]}',
        '{"courts": [{"code": "D", "limits": {"pages": 2}, "share": 0.5, "names": ["x", "y"], "odd": 1, "more": 2}, {"code": "E", "limits": {"pages": 1}}, {"code": "E", "limits": {"pages": 2}}, 7, null]}',
        "{", "[]", None, "", '{"courts": 5}', '{"courts": []}',
    )
    assert rows == [("f0", "A", 3, 1.0, [])]
    assert violations == sorted([
        ("f0", "courts[1].limits.pages", "not a int"), ("f0", "courts[2].limits.pages", "missing"), ("f0", "courts[3].code", "missing"), ("f0", "courts[3].limits.pages", "below 1"),
        ("f1", "courts[0].more", "unknown"), ("f1", "courts[0].odd", "unknown"), ("f1", "courts[1].code", "repeated"), ("f1", "courts[2].code", "repeated"), ("f1", "courts[3]", "not an object"), ("f1", "courts[4]", "not an object"),
        ("f2", "$", "not readable"), ("f3", "courts", "missing"), ("f4", "$", "not readable"), ("f5", "$", "not readable"), ("f6", "courts", "missing"),
    ])


def test_load_refuses_with_all_it_found(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text('{"courts": [\n{"code": "A", "limits": {"pages": 3}}]}')
    assert [r.code for r in settings.load(spark, str(tmp_path), "courts", FIELDS).collect()] == ["A"]
    (tmp_path / "b.json").write_text('{"courts": [{"code": "B", "limits": {"pages": -1}, "x": 1}]}')
    with pytest.raises(ValueError, match=r"courts\[0\]\.limits\.pages: below 1; .*courts\[0\]\.x: unknown"):
        settings.load(spark, str(tmp_path), "courts", FIELDS)


def test_pages_follow_their_marks(spark):
    df = spark.createDataFrame([(k // 3, k, f"n{k}") for k in range(10)], "rank int, id int, name string")
    mark, read = None, []
    for _ in range(4):
        rows = access.page(df, ["rank", "id"], 4, mark).orderBy("rank", "id").collect()
        read += [r.id for r in rows]
        assert {r.total for r in rows} == {10} and len({r.next for r in rows}) == 1
        mark = rows[0].next
        if mark is None:
            break
    assert read == list(range(10))
    assert [r.id for r in access.page(df, ["id"], 20, descending=True).collect()] == list(range(9, -1, -1))
    assert access.page(df.limit(0), ["id"], 4).collect() == []


@pytest.mark.parametrize("mark", ["x", "", "bm90", "WzFd", "eyJhIjoxfQ=="])
def test_marks_that_are_none(mark):
    with pytest.raises(ValueError, match="no mark"):
        access.seen(mark, "a", "b")
