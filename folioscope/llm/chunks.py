"""Documents packed into chunks, hashes dealt to buckets, and arrays as compressed values.

Operators that look for what documents share write their chunks to the shared folder once, send each chunk's distinct
hashes to the hashes' buckets, and send what a bucket finds back to the chunks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import cut, settle, steps, texts

#: Text bytes from which a chunk is closed.
CHUNK = 4 << 20
_U = np.uint64


class Chunk:
    """Documents' ids and texts, as one compressed value."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, data: np.ndarray):
        self.ids, self.starts, self.data = ids, starts, data

    @staticmethod
    def dump(ids: list[int], values: list[bytes]) -> bytes:
        head = struct.pack("<q", len(ids)) + np.array(ids, np.int64).tobytes() + np.cumsum([0, *map(len, values)]).astype(np.int64).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(values))

    @classmethod
    def load(cls, value: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(value)
        n = struct.unpack_from("<q", raw)[0]
        return cls(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n), np.frombuffer(raw, np.uint8)[16 + 16 * n :])

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, room = TaskContext.get().partitionId() << 32, [], size

        def flush():
            nonlocal part, held, room
            ids, values = [h[0] for h in held], [h[1] for h in held]
            row = [
                pa.array([part]), pa.array([ids], pa.list_(pa.int64())), pa.array([[hashlib.sha256(v).digest() for v in values]], pa.list_(pa.binary())),
                pa.array([Chunk.dump(ids, values)], pa.binary()),
            ]
            part, held, room = part + 1, [], size
            return pa.RecordBatch.from_arrays(row, names=["chunk", "ids", "digests", "data"])

        for batch in steps(batches, "text"):
            for one in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                held.append(one)
                room -= len(one[1])
                if room <= 0:
                    yield flush()
        if held:
            yield flush()

    return run


def pack(rows: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """chunk, ids, digests (SHA-256 of each text) and data of ``rows`` (doc_id long, text), cut in the shared folder.

    Rows without an id take no part.
    """
    return cut(rows.where("doc_id is not null").mapInArrow(_packer(size or CHUNK), "chunk long, ids array<long>, digests array<binary>, data binary"), name)


def later_copies(chunks: DataFrame) -> DataFrame:
    """chunk and copies: places of documents whose text a document with a smaller id has too."""
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "one")).select("chunk", "place", "one.*")
    least = each.groupBy("digests").agg(F.min("ids").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(least, "digests").where("ids > least").groupBy("chunk").agg(F.collect_list("place").alias("copies"))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows' values one by one: a batch may hold many large values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(n)[i].as_py() for n in names)
    batch = None
    settle()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; equal byte places of a number stand together."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        out.append(struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)) + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def spread(value: bytes) -> list[np.ndarray]:
    """The arrays of ``squeeze``."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 4, []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        kind, width, n = struct.unpack_from("<cBQ", raw, at)
        at += struct.calcsize("<cBQ")
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(f"{kind.decode()}{width}").ravel())
        at += n * width
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=_U(0))
