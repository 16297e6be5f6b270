"""The whole pipeline on a very long text, its near copy, ties and repeated rows."""

import random

import corpus_pipeline

from .conftest import PROSE, SCHEMA, rows


def test_a_very_long_text_goes_through(spark, tmp_path):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(4000)]
    long = " ".join(rnd.choice(words) for _ in range(150_000))
    table = [(1, PROSE * 5), (2, long), (3, long + " and a few words more"), (4, PROSE * 5), (4, PROSE * 5), (5, " ".join(rnd.choice(words) for _ in range(60)))]
    spark.createDataFrame(rows(table), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words stand in any text of this small table here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 2, 5}
    pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 2)
    assert len(pieces) > 100 and [p for p, _, _ in pieces] == list(range(len(pieces)))
    assert all(start == 2048 * piece for piece, start, _ in pieces) and all(length == 2048 for _, _, length in pieces[:-1])
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
