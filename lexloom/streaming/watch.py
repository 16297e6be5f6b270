"""A watched folder: scans as a stream, files that settle become load requests and move to done, others to failed.

The source lists <root>/<source>/<doc_type>/ at each trigger; state tells which files have settled; each batch adds its
requests to a folder of its own number and then moves its files. A file's new name is made from what was seen of it, so a
batch that is run again after a crash moves nothing twice: what it had moved is not listed again and has its request, and
what it had not moved gets the same request once more (`requests` gives each once).
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import Store
from . import state

REQUEST = "source string, doc_type string, file string, problem string"
SCAN = "path string, size long, mtime long, scan long, at timestamp"
#: The types of documents that a folder may be named after.
KINDS = ("act", "rules", "notification", "circular", "instruction", "order", "judgement")
_HEAD = {"application/pdf": (b"%PDF-",), "text/html": (b"<!doctype html", b"<html", b"<head", b"<body")}


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path below root, size, nanoseconds of change) of files two folders deep; names that begin with a dot are left out."""
    store = Store(root)
    cut = len(store.base.rstrip("/")) + 1
    infos = store.files.get_file_info(fs.FileSelector(store.base, recursive=True, allow_not_found=True))
    rows = [(i.path[cut:], i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File]
    return sorted(r for r in rows if len(r[0].split("/")) == 3 and not any(p.startswith(".") for p in r[0].split("/")))


class _Scans(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"scan": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = datetime.now(UTC)
        return iter([(*row, start["scan"], now) for row in listed(self.root)]), {"scan": start["scan"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """A scan whose batch did not end is made again: no state knows it yet."""
        return self.read({"scan": end["scan"] - 1})[0]

    def commit(self, end: dict) -> None:
        pass


class FolderScans(DataSource):
    """spark.readStream.format("folder_scans").load(root): a row for each file and scan."""

    @classmethod
    def name(cls) -> str:
        return "folder_scans"

    def schema(self) -> str:
        return SCAN

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Scans(self.options["path"])


def problem(root: str, path: str) -> str | None:
    """Why a file cannot be loaded."""
    store = Store(root)
    kind = path.split("/")[1]
    if kind not in KINDS:
        return f"unknown document type: {kind}"
    with store.files.open_input_stream(store.at(path)) as file:
        head = file.read(1024).removeprefix(b"\xef\xbb\xbf").lstrip().lower()
    return None if any(head.startswith(x.lower()) for heads in _HEAD.values() for x in heads) else "neither PDF nor HTML"


def planned(root: str, path: str, size: int, mtime: int) -> tuple[str, str | None]:
    """Where a settled file goes, and why it cannot be loaded."""
    mark = hashlib.sha256(f"{path} {size} {mtime}".encode()).hexdigest()[:32]
    name = f"{mark}__{path.rsplit('/', 1)[1]}"
    why = problem(root, path)
    return (f".failed/{name}" if why else f".done/{datetime.fromtimestamp(mtime / 1e9, UTC):%Y%m%d}/{name}"), why


def move(root: str, path: str, target: str, why: str | None) -> None:
    """Move a file to its place, unless that was done before; beside a failed one stands the reason."""
    store = Store(root)
    if store.exists(target) or not store.exists(path):
        return
    if why:
        store.put(f"{target}.reason.txt", f"{why[:2000]}\n".encode())  # first, so that no file is there without it
    store._move(store.at(path), store.at(target))


def requests(spark: SparkSession, out: str) -> DataFrame:
    """The load requests so far: source, doc_type, file and problem of each file."""
    return spark.read.schema(REQUEST).parquet(f"{out}/requests/*").distinct()


def watch(spark: SparkSession, root: str, out: str, needed: int = 2, seconds: float = 10.0) -> StreamingQuery:
    """Watch a folder and write load requests below `out`; started again with the same `out`, it goes on where it was.

    A trigger's files are few: their names reach the driver.
    """
    spark.dataSource.register(FolderScans)
    told = state.settled(spark.readStream.format("folder_scans").load(root), needed, "1 minute")

    def take(batch: DataFrame, number: int) -> None:
        plans = []
        for r in batch.collect():
            try:
                plans.append((r["path"], *planned(root, r["path"], r["size"], r["mtime"])))
            except FileNotFoundError:
                continue  # it went before it was taken
        if plans:
            rows = [(*path.split("/")[:2], target, why) for path, target, why in plans]
            spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{out}/requests/batch={number}")
        for path, target, why in plans:
            move(root, path, target, why)

    with state.kept_in_rocksdb(spark):
        run = told.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", f"{out}/state").trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
        while run.isActive and not run.recentProgress and not run.exception():
            time.sleep(0.1)  # the settings of its start hold for all its batches
    return run
