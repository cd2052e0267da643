"""Which texts hold which passages, at any place: hashes of all byte windows, looked up, then the passage itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

#: Text bytes hashed at once; windows are powers of two up to the widest, passages below the least are searched for one by one.
STEP_BYTES, WIDEST, LEAST = 1 << 20, 32, 8

_RANDOM = np.random.default_rng(40)
_BYTES, _MIX = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64), _RANDOM.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = np.uint64(44)


def _hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the window at each place), each width from the one of half its size."""
    h, width = _BYTES[data], 1
    for mix in _MIX:
        yield width, h
        if width == WIDEST or len(h) <= width:
            return
        h = h[:-width] * mix + h[width:]
        width *= 2


class Passages:
    def __init__(self, items: list[tuple[object, bytes]]):
        self.short = [(k, t) for k, t in items if len(t) < LEAST]
        self.by_head: dict[int, dict[bytes, list[tuple[object, bytes]]]] = {}
        for k, t in items:
            if len(t) >= LEAST:
                width = min(WIDEST, 1 << (len(t).bit_length() - 1))
                self.by_head.setdefault(width, {}).setdefault(t[:width], []).append((k, t))
        self.known = {}
        for width, heads in self.by_head.items():
            found = np.unique([dict(_hashes(np.frombuffer(h, np.uint8)))[width][0] for h in heads])
            some = np.zeros(1 << 20, bool)
            some[found >> _PART] = True
            self.known[width] = found, some

    def find(self, texts: list[bytes]) -> list[tuple[int, object]]:
        """(number of the text, item) of each pair where the text holds the item."""
        whole, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        out = [(row, k) for k, t in self.short for row, text in enumerate(texts) if t in text]
        pairs: dict[tuple[int, int], tuple[int, object]] = {}
        for width, h in _hashes(np.frombuffer(whole, np.uint8)):
            if width not in self.known:
                continue
            found, some = self.known[width]
            at = np.flatnonzero(some[h >> _PART])
            at = at[found[np.minimum(np.searchsorted(found, h[at]), len(found) - 1)] == h[at]]
            for i, row in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
                for entry in self.by_head[width].get(whole[i : i + width], ()):
                    if (row, id(entry)) not in pairs and i + len(entry[1]) <= ends[row] and whole.startswith(entry[1], i):
                        pairs[row, id(entry)] = row, entry[0]
        return out + list(pairs.values())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + STEP_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def holding(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, key) of each pair of rows where the document's text holds the item's; null and empty items are in no text."""
    rows = [(r[0], r[1].encode()) for r in items.select(item, text).toLocalIterator() if r[1]]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = T.StructType([items.schema[item], docs.schema[key]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value)
        for batch in batches:
            for part in _slices(batch):
                keys = part.column(0).to_pylist()
                found = passages.find([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                if found:
                    kind = pa.array([r[0] for r in shared.value]).type
                    yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], kind), pa.array([keys[row] for row, _ in found], part.column(0).type)], names=[item, key])

    return docs.select(key, text).mapInArrow(find, schema)
