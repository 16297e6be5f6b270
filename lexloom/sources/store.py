"""Objects by key in a store that all executors reach, as a data source and as a sink that stores each content once.

Keys are relative paths; `raw/<two digits>/<digest>` names a content. A write puts its contents into a folder of its own
beside the objects and moves them to their keys when all tasks are done; a write that fails leaves nothing, and of two
writers of one content the second finds it there. Paths may be of any store that pyarrow knows (file, hdfs, s3).
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROW = "key string, length long, content binary"
_STAGE = ".staging"
_BAD = re.compile(r"(^/)|(/$)|(//)|(\\)|(\x00)|((^|/)\.\.(/|$))|^$")


def checked(key: str) -> str:
    """The key, if it is relative and without `..`, empty parts, backslashes and NULs."""
    if _BAD.search(key):
        raise ValueError(f"not a key: {key!r}")
    return key


def raw_key(content: bytes) -> str:
    digest = hashlib.sha256(content).hexdigest()
    return f"raw/{digest[:2]}/{digest}"


class Store:
    """Single objects: put, get, exists, delete and list."""

    def __init__(self, root: str):
        self.files, self.base = fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")

    def at(self, key: str) -> str:
        return f"{self.base.rstrip('/')}/{checked(key)}"

    def put(self, key: str, content: bytes) -> None:
        """Write an object whole: readers see the old content or the new one."""
        part = self.at(f"{_STAGE}/{uuid.uuid4().hex}")
        self._write(part, content)
        self._move(part, self.at(key))

    def _write(self, path: str, content: bytes) -> None:
        self.files.create_dir(os.path.dirname(path), recursive=True)
        with self.files.open_output_stream(path) as out:
            out.write(content)

    def _move(self, part: str, path: str) -> None:
        self.files.create_dir(os.path.dirname(path), recursive=True)
        self.files.move(part, path)

    def exists(self, key: str) -> bool:
        return self.files.get_file_info(self.at(key)).type == fs.FileType.File

    def get(self, key: str) -> bytes:
        with self.files.open_input_stream(self.at(key)) as file:
            return file.read()

    def delete(self, key: str) -> bool:
        """Whether there was such an object."""
        there = self.exists(key)
        if there:
            self.files.delete_file(self.at(key))
        return there

    def list(self, prefix: str = "") -> list[tuple[str, int]]:
        """(key, length) of the objects below a prefix, in the order of their keys."""
        where = f"{self.base.rstrip('/')}/{prefix}".rstrip("/") if prefix else self.base
        cut = len(self.base.rstrip("/")) + 1
        infos = self.files.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
        return sorted((i.path[cut:], i.size) for i in infos if i.type == fs.FileType.File and not i.path[cut:].startswith(_STAGE))


@dataclass
class _Keys(InputPartition):
    keys: list[tuple[str, int]]


class _Reader(DataSourceReader):
    #: Bytes that a task reads, as far as single objects allow.
    SIZE = 64 << 20

    def __init__(self, options: dict[str, str]):
        self.root, self.prefix = options["path"], options.get("prefix", "")
        self.size = int(options.get("partitionbytes", self.SIZE))

    def partitions(self) -> list[_Keys]:
        out, size = [_Keys([])], 0
        for key, length in Store(self.root).list(self.prefix):
            if out[-1].keys and size + length > self.size:
                out.append(_Keys([]))
                size = 0
            out[-1].keys.append((key, length))
            size += length
        return out

    def read(self, partition: _Keys) -> Iterator[tuple]:
        store = Store(self.root)
        for key, length in partition.keys:
            yield key, length, store.get(key)


@dataclass
class _Staged(WriterCommitMessage):
    """A task's folder, the digests of the contents in it one behind the other, and the keys that were given: 32 bytes for a content."""

    folder: str
    digests: bytes
    named: list[str]

    def moves(self) -> Iterator[tuple[str, str]]:
        """(place in the folder, key) of each object."""
        for k in range(0, len(self.digests), 32):
            digest = self.digests[k : k + 32].hex()
            yield f"{self.folder}/{digest}", f"raw/{digest[:2]}/{digest}"
        for k, key in enumerate(self.named):
            yield f"{self.folder}/named-{k}", key


class _Writer(DataSourceWriter):
    """Rows with `content`, and `key` where it is not the content's own."""

    def __init__(self, options: dict[str, str]):
        self.root, self.stage = options["path"], f"{_STAGE}/{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Staged:
        store, folder = Store(self.root), f"{self.stage}/{uuid.uuid4().hex}"
        digests, named = set(), {}
        for row in rows:
            given = row.asDict()
            content = bytes(given["content"])
            key = checked(given["key"]) if given.get("key") else None
            if key is None:
                digest = hashlib.sha256(content).digest()
                if digest not in digests and not store.exists(f"raw/{digest.hex()[:2]}/{digest.hex()}"):
                    store._write(store.at(f"{folder}/{digest.hex()}"), content)
                    digests.add(digest)
            elif key not in named:
                store._write(store.at(f"{folder}/named-{len(named)}"), content)
                named[key] = len(named)
        return _Staged(folder, b"".join(digests), list(named))

    def commit(self, messages: list) -> None:
        store = Store(self.root)
        moves = {key: part for m in messages if m for part, key in m.moves()}  # one of each key, whichever task wrote it
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store._move(store.at(x[1]), store.at(x[0])), moves.items()))
        self._clear(store)

    def abort(self, messages: list) -> None:
        self._clear(Store(self.root))

    def _clear(self, store: Store) -> None:
        where = store.at(self.stage)
        if store.files.get_file_info(where).type == fs.FileType.Directory:
            store.files.delete_dir(where)


class ObjectStore(DataSource):
    """spark.read.format("object_store").load(root), with prefix and partitionBytes; df.write.format("object_store").mode("append").save(root)."""

    @classmethod
    def name(cls) -> str:
        return "object_store"

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are added and not replaced as a whole: use append")
        return _Writer(dict(self.options))


def stored(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """The objects below a prefix."""
    spark.dataSource.register(ObjectStore)
    return spark.read.format("object_store").option("prefix", prefix).load(root)


def store(contents: DataFrame, root: str) -> None:
    """Store each content (and key, where given) once."""
    contents.sparkSession.dataSource.register(ObjectStore)
    contents.write.format("object_store").mode("append").save(root)
