"""What the operators share: tables, scratch tables in the shared folder, folds and pieces of Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that Python works on at once. Spark itself bounds the bytes of an Arrow batch.
PIECE_ROWS, PIECE_BYTES = 512, 2_000_000

_scratch: dict[str, str] = {}
#: How to drop what an operator keeps in a Python worker from task to task.
_kept: dict[str, Callable[[], None]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and `size` bytes of a string column; a longer text is a slice of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(upto, before + size, side="right"))), at + rows)
            yield batch.slice(at, end - at)
            at = end


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """An operator says how to drop what it keeps in a worker."""
    _kept[owner] = drop


def begins(owner: str) -> None:
    """A task of an operator begins: workers are reused, so what others have kept in this one is dropped."""
    for other, drop in _kept.items():
        if other != owner:
            drop()


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that start inside send at most so many rows at once to Python; the session's own setting is put back behind them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, removed at the driver's exit.

    Only where the setting is missing and Spark runs in this one process (tests) a temporary folder takes its place; on
    a cluster each executor would write to its own disk, so the setting is asked for.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        _scratch[app] = f"{base.rstrip('/')}/lexloom-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: the cluster's own clean-up takes the folder
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, on disk all executors share.

    What the driver no longer holds is collected at once, so that Spark's cleaner deletes the shuffle files behind it: a
    driver with a large heap would keep them on the executors' disks for hours.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def text_key(text: Column) -> Column:
    """64 bits of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
