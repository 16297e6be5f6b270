"""Token-ID output: a wavelet matrix for each shard of documents in ascending order of doc_id.

A shard's tokens are mapped to its own alphabet (its distinct ids, in order) and stored as bit-planes, highest bit first;
each plane keeps its zeros before its ones for the next. With counts of ones at every BLOCK bits, `rank` and `select`
give any token (`access`), the number of a token's occurrences (`count`) and their places (`locate`) from the one
compressed record. `write` makes a Parquet folder with one record a shard, `read_back` decodes it again.

Defined cases: a null text is empty and has only the end id; null doc_ids come first; repeated doc_ids follow each other,
ordered by the hash of their texts; an empty table gives an empty folder; other columns are not stored. Rows are ordered
by buckets of doc_id (quantiles), so no task sorts all of them; a shard ends at SHARD tokens, a longer document is one,
read whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_root, slices, text_key
from .ordering import BUCKET, bounds_of, bucket_of
from .tokens import coder, vocabulary_path

END_ID = 2
SHARD = 2_000_000
#: Bits between counts of ones, and bytes of a plane that are compressed together.
BLOCK, CHUNK = 512, 1 << 16
_MISSING = -(2**63)


def build(values: np.ndarray) -> dict:
    """The wavelet matrix of an array of token ids."""
    alphabet = np.flatnonzero(np.bincount(values)) if len(values) else np.zeros(0, dtype=np.int64)
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 0, dtype=np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    now = place[values] if len(values) else values.astype(np.uint32)
    if len(alphabet) <= 1 << 16:
        now = now.astype(np.uint16)
    planes, zeros = [], []
    for shift in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
        bit = ((now >> shift) & 1).astype(bool)
        planes.append(np.packbits(bit))
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate([low, now[bit]])
    return {"n": len(values), "alphabet": alphabet.astype(np.uint32), "planes": planes, "zeros": zeros}


def pack(matrix: dict, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One compressed record: a frame with the counts of ones and the documents' ids and lengths, then one for each CHUNK of each plane.

    The frames' places stand at the record's head, so a look-up opens only the chunks it passes through.
    """
    planes = [p.tobytes() for p in matrix["planes"]]
    ranks = [np.concatenate([[0], np.cumsum(np.add.reduceat(_ones(p), np.arange(0, len(p), BLOCK // 8)))]).astype(np.uint32) if len(p) else np.zeros(1, np.uint32) for p in matrix["planes"]]
    small = [np.array(matrix["zeros"], dtype=np.uint64), matrix["alphabet"], doc_ids.astype(np.int64), lengths.astype(np.uint64), *ranks]
    coder = zstandard.ZstdCompressor(level=1)
    frames = [coder.compress(b"".join(x.tobytes() for x in small)), *(coder.compress(p[k : k + CHUNK]) for p in planes for k in range(0, len(p), CHUNK))]
    head = struct.pack("<5Q", matrix["n"], len(matrix["alphabet"]), len(planes), len(doc_ids), len(frames))
    return b"".join([head, np.cumsum([0, *map(len, frames)]).astype("<u8").tobytes(), *frames])


def _ones(plane: np.ndarray) -> np.ndarray:
    return np.bitwise_count(plane).astype(np.int64)


class Shard:
    """Reads one record; chunks of planes are opened when they are asked for, and kept."""

    def __init__(self, record: bytes):
        self.n, letters, levels, docs, frames = struct.unpack_from("<5Q", record)
        places = np.frombuffer(record, "<u8", frames + 1, 40).astype(np.int64) + 40 + 8 * (frames + 1)
        self.record, self.places, self.opened = memoryview(record), places.tolist(), {}
        raw, at = self._frame(0), 0

        def take(count: int, kind: type) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.zeros = take(levels, np.uint64).astype(np.int64)
        self.alphabet = take(letters, np.uint32)
        self.doc_ids = take(docs, np.int64)
        self.lengths = take(docs, np.uint64).astype(np.int64)
        self.size = (self.n + 7) // 8
        blocks = -(-self.size // (BLOCK // 8)) + 1
        self.ranks = [take(blocks, np.uint32) for _ in range(levels)]
        self.chunks = -(-self.size // CHUNK)

    def _frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.record[self.places[k] : self.places[k + 1]])

    def _bytes(self, level: int, first: int, last: int) -> np.ndarray:
        """Bytes of a plane that lie in one chunk."""
        chunk = first // CHUNK
        if (level, chunk) not in self.opened:
            self.opened[level, chunk] = np.frombuffer(self._frame(1 + level * self.chunks + chunk), dtype=np.uint8)
        return self.opened[level, chunk][first - chunk * CHUNK : last - chunk * CHUNK]

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block = i // BLOCK
        first = block * BLOCK // 8
        if first == self.size or i % BLOCK == 0:
            return int(self.ranks[level][block])
        own = self._bytes(level, first, i // 8 + (1 if i % 8 else 0))
        whole = int(self.ranks[level][block]) + int(np.bitwise_count(own[: i // 8 - first]).sum())
        return whole + (int(own[-1] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The token at place i."""
        value = 0
        for level, zeros in enumerate(self.zeros.tolist()):
            bit = (int(self._bytes(level, i // 8, i // 8 + 1)[0]) >> (7 - i % 8)) & 1
            ones = self._rank(level, i)
            value = 2 * value + bit
            i = zeros + ones if bit else i - ones
        return int(self.alphabet[value])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before place i."""
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _range(self, token: int, i: int) -> tuple[int, int]:
        letter = int(np.searchsorted(self.alphabet, token))
        if letter == len(self.alphabet) or self.alphabet[letter] != token:
            return 0, 0
        a, b = 0, i
        for level, zeros in enumerate(self.zeros.tolist()):
            x, y = self._rank(level, a), self._rank(level, b)
            a, b = (zeros + x, zeros + y) if letter >> (len(self.zeros) - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def select(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence, from 0."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        letter, i = int(np.searchsorted(self.alphabet, token)), a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one = letter >> (len(self.zeros) - 1 - level) & 1
            i = self._find(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def _find(self, level: int, one: int, k: int) -> int:
        """The place of the k-th one (or zero) of a plane."""
        counts = self.ranks[level].astype(np.int64)
        if not one:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self._bytes(level, block * BLOCK // 8, (block + 1) * BLOCK // 8))
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens, plane by plane from the lowest."""
        levels = len(self.zeros)
        value = np.zeros(self.n, dtype=np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            plane = b"".join(self._frame(1 + level * self.chunks + k) for k in range(self.chunks))
            bit = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=self.n).astype(bool)
            zeros = int(self.zeros[level])
            up = np.empty_like(value)
            up[~bit] = value[:zeros]
            up[bit] = value[zeros:] | value.dtype.type(1 << (levels - 1 - level))
            value = up
        return self.alphabet[value] if self.n else np.zeros(0, dtype=np.uint32)


def shards(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row a shard: bucket, seq (order within it), n_docs, n_tokens, record."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    n = max(32, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = docs.select("doc_id", "text")
    rows = rows.withColumn(BUCKET, bucket_of(F.col("doc_id"), bounds_of(rows, 4 * n)))
    placed = rows.repartition(n, BUCKET).sortWithinPartitions(BUCKET, F.col("doc_id").asc_nulls_first(), text_key(F.col("text"))).select("doc_id", "text", BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, own, size, at, seq = [], [], 0, None, 0

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), dtype="<u4")
            record = pack(build(values), np.array([_MISSING if d is None else d for d in own], dtype=np.int64), np.array([len(x) // 4 for x in ids]))
            return pa.RecordBatch.from_pydict({"bucket": [at], "seq": [seq], "n_docs": [len(own)], "n_tokens": [len(values)], "record": [record]}, schema=kinds)

        kinds = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("record", pa.binary())])
        for batch in slices(batches):
            for doc_id, text, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (bucket != at or size >= SHARD):
                    yield close()
                    ids, own, size, seq = [], [], 0, seq + 1 if bucket == at else 0
                at = bucket
                ids.append(encode(text) + end)
                own.append(doc_id)
                size += len(ids[-1]) // 4
        if own:
            yield close()

    return placed.mapInArrow(run, "bucket int, seq int, n_docs long, n_tokens long, record binary")


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    shards(docs, vocabulary, end_id).write.option("compression", "none").parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens, ids_crc32."""
    kept = spark.read.schema("bucket int, seq int, n_docs long, n_tokens long, record binary").parquet(path)
    sums = {r["bucket"]: r["n"] for r in kept.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect()}  # a few buckets a partition
    before, first = 0, []
    for bucket in sorted(sums):
        first.append((bucket, before))
        before += sums[bucket]
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.select("bucket", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    starts = starts.join(F.broadcast(spark.createDataFrame(first or [(0, 0)], "bucket int, before long")), "bucket").select("bucket", "seq", (F.col("inside") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(record)
                raw = memoryview(shard.decode().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crcs = [crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == _MISSING)
                yield pa.RecordBatch.from_arrays([ids, pa.array(begins + start), pa.array(shard.lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return kept.join(starts, ["bucket", "seq"]).select("record", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' ids into the shared folder and read them back."""
    path = f"{scratch_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocabulary)
    return read_back(docs.sparkSession, path)
