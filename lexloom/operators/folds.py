"""Ordered folds: a key's rows in order through a small step function, streamed within sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

OUT_ROWS = 2000


def arrow_udf(f: Callable, kind: str) -> Callable[..., Column]:
    """An Arrow-batched function of columns; its type is read when it is first used, so a module can be imported without a session."""
    return lambda *columns: F.udf(f, kind, useArrow=True)(*columns)


def folded(df: DataFrame, keys: list[str], order: list[str | Column], body: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str, partitions: int | None = None) -> DataFrame:
    """body(key, rows in order) gives the rows of `schema` for each key.

    Rows are hashed by key and sorted, and body reads them one by one: a key with very many rows costs time in its task,
    not memory. rows are tuples of df's columns. Partitions are those of a shuffle unless a number is given.
    """
    kind: StructType = _parse_datatype_string(schema)
    places = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for key, own in groupby(rows, lambda r: tuple(r[p] for p in places)):
            for made in body(key, own):
                out.append(made)
                if len(out) >= OUT_ROWS:
                    yield _batch(out, arrow)
                    out = []
        yield _batch(out, arrow)

    placed = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
