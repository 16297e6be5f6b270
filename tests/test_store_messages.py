"""What tasks of the object store's sink tell the driver."""

import pickle

from pyspark.sql import Row

from lexloom.sources import store


def test_a_content_costs_the_driver_its_digest_alone(tmp_path):
    writer = store._Writer({"path": str(tmp_path)})
    contents = [b"%d" % (k % 100) for k in range(200)]
    told = writer.write(iter([Row(content=c) for c in contents]))
    assert len(pickle.dumps(told)) < 40 * 100 + 300
    named = writer.write(iter([Row(key="meta/a", content=b"x"), Row(key="meta/a", content=b"y"), Row(key="raw/own", content=b"z"), Row(key=None, content=b"0")]))
    writer.commit([told, named])
    kept = store.Store(str(tmp_path))
    assert [k for k, _ in kept.list()] == sorted({store.raw_key(c) for c in contents} | {"meta/a", "raw/own"})
    assert kept.get("meta/a") == b"x" and all(kept.get(store.raw_key(c)) == c for c in contents)
