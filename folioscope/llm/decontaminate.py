"""Benchmark decontamination: a hash set of test n-grams against every token window of the training documents.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Each window of ``n`` consecutive words of an
item, or the whole item if it has fewer words (but not none), is one window. The windows' hashes are broadcast in
blocks of bounded size, as arrays; each document window is looked up by hash and every hit is verified word by word.

Defined results: a null or empty text has no words and no hits; a null item id takes no part; repeated rows each get
their own result; an empty benchmark hits nothing; extra columns pass through untouched; result columns that clash with
input columns replace them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, steps, texts

WINDOW = 13
#: Bytes of benchmark text, and distinct words, whose windows one broadcast holds (some 100 MB in a worker at most); a
#: larger benchmark is scanned for in several passes.
BLOCK_BYTES, VOCABULARY = 16 << 20, 400_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = np.zeros(1, np.int32)
_ROW = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_longest", T.LongType()), T.StructField("hits", T.BinaryType()),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Block:
    """Some benchmark items' words, numbered, as they are gathered."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, item: str, text: bytes) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
        if ids:
            self.names.append(item)
            self.parts.append(np.array(ids, np.int32))
            self.size += len(text)

    def full(self, more: int, limit: int) -> bool:
        return bool(self.names) and (self.size + more > limit or len(self.vocabulary) > VOCABULARY)


class Windows:
    """The distinct windows of a block, by size: sorted hashes, a place of each in the items' words, and the items with it."""

    def __init__(self, block: Block, n: int):
        self.vocabulary, self.names = block.vocabulary, block.names
        self.flat = np.concatenate([np.zeros(0, np.int32), *block.parts])
        self.mixed = np.random.default_rng(13).integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        lengths = np.array([len(p) for p in block.parts], np.int64)
        starts, sizes = np.cumsum(lengths) - lengths, np.minimum(lengths, n)
        self.by_size = {}
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            counts = lengths[own] - size + 1
            item = np.repeat(own, counts).astype(np.int32)
            place = np.repeat(starts[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = self._hash(self.flat, place, size)
            order = np.lexsort((place, hashes))
            item, place, hashes = item[order], place[order].astype(np.int32), hashes[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | ~self._same(self.flat, place[1:], place[:-1], size))
            window = np.cumsum(new) - 1
            pairs = np.unique(window.astype(np.int64) << 32 | item)
            bounds = np.searchsorted(pairs >> 32, np.arange(window[-1] + 2))
            self.by_size[size] = hashes[new], place[new], bounds.astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)

    def _hash(self, ids: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(places), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.mixed[ids[places + k]]
        return h

    def _same(self, ids: np.ndarray, places: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
        """Whether the words of ``ids`` from each place on are those of the items' words from ``own`` on."""
        same = np.ones(len(places), bool)
        for k in range(size):
            same &= ids[places + k] == self.flat[own + k]
        return same

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, starts, the items' bounds, items) of the windows in ``ids``; 0 stands for any word that no item has.

        A place is looked up by hash; each window with that hash is then compared word by word.
        """
        zeros = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, places, bounds, items) in self.by_size.items():
            at = np.flatnonzero(zeros[size:] == zeros[:-size])
            if not len(at):
                continue
            h = self._hash(ids, at, size)
            near = np.searchsorted(hashes, h)
            while len(at):  # several windows of one hash stand side by side
                live = (near < len(hashes)) & (hashes[np.minimum(near, len(hashes) - 1)] == h)
                at, h, near = at[live], h[live], near[live]
                same = self._same(ids, at, places[near], size)
                if same.any():
                    yield size, at[same], np.stack([bounds[near[same]], bounds[near[same] + 1]], 1), items
                at, h, near = at[~same], h[~same], near[~same] + 1


def _searched(windows: Windows, batch: pa.RecordBatch, column: str) -> list[pa.Array]:
    """The result columns of a batch's documents, those of earlier passes included."""
    parts, get = [], windows.vocabulary.get
    for text in texts(batch.column(column)):
        found = words(text)
        parts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    ids = np.concatenate([x for part in parts for x in (part, _GAP)])  # a gap keeps windows inside a document
    before = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * len(starts)
    earlier = batch.column("items").to_pylist() if "items" in batch.schema.names else [None] * len(starts)
    items = [set(old or ()) for old in earlier]
    edges = np.zeros(len(ids) + 1, np.int64)
    for row, old in enumerate(before):
        for i, j in np.frombuffer(old or b"", np.int64).reshape(-1, 2) + starts[row]:
            edges[i] += 1
            edges[j] -= 1
    for size, at, bounds, which in windows.find(ids):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        rows = np.searchsorted(starts, at, side="right") - 1
        for row, i, j in np.unique(np.column_stack([rows, bounds]), axis=0).tolist():
            items[row].update(windows.names[k] for k in which[i:j].tolist())
    hit = np.append(np.cumsum(edges[:-1]) > 0, False).astype(np.int8)
    turns = np.diff(hit, prepend=0)
    spans = np.stack([np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)], 1)
    row = np.searchsorted(starts, spans[:, 0], side="right") - 1
    cuts, sizes = np.searchsorted(row, np.arange(len(starts) + 1)).tolist(), spans[:, 1] - spans[:, 0]
    inside = (spans - starts[row, None]).astype(np.int64)
    longest = np.zeros(len(starts), np.int64)
    np.maximum.at(longest, row, sizes)
    return [
        pa.array(lengths, pa.int64()),
        pa.array(np.bincount(row, sizes, len(starts)).astype(np.int64), pa.int64()),
        pa.array(longest, pa.int64()),
        pa.array([inside[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        pa.array([sorted(s) for s in items], pa.list_(pa.string())),
    ]


def _scan(column: str, shared, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column):
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_searched(shared.value, batch, column)], names=[*names, *_ROW.names])

    return scan


def _strip(column: str, shared, names: list[str], longest: int | None):
    """The rows without their hit spans; with ``longest``, without the rows that are contaminated or hold so many hit words in a row."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column):
            n_words, n_hit, n_longest, hits, _ = _searched(shared.value, batch, column)
            n_words, n_hit, n_longest = (np.asarray(x) for x in (n_words, n_hit, n_longest))
            stay = np.ones(batch.num_rows, bool) if longest is None else ((n_hit == 0) | (20 * n_hit < n_words)) & (n_longest < longest)
            kept = pa.array(stay)
            batch, out = batch.filter(kept), []
            for value, found in zip(texts(batch.column(column)), hits.filter(kept).to_pylist(), strict=True):
                ends, parts, at = [m.span() for m in _WORD.finditer(value)] if found else [], [], 0
                for i, j in np.frombuffer(found, np.int64).reshape(-1, 2).tolist():
                    parts.append(value[at : ends[i][0]])
                    at = ends[j - 1][1]
                out.append(b"".join([*parts, value[at:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == column else batch.column(n) for n in names], names=names)

    return strip


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``n_hit`` (words inside windows), ``n_longest`` (those of the longest run),
    ``hits`` (int64 pairs: merged runs of hit words) and ``items`` (ids of found items as strings, sorted)."""
    names = [c for c in docs.columns if c not in _ROW.names]
    keep = names if keep is None else keep
    rows, shared = _last(docs.select(names), benchmark, text, **options)
    return rows.mapInArrow(_scan(text, shared, keep), T.StructType([rows.schema[c] for c in keep] + list(_ROW)))


def _last(docs: DataFrame, benchmark: DataFrame, text: str, *, item: str = "item_id", item_text: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The documents and the broadcast windows of the last pass over them.

    The benchmark passes through the driver a block at a time, so that only one block is ever held or broadcast; each
    block but the last costs one more pass over the documents, cut in the shared folder.
    """
    names, size = docs.columns, F.coalesce(F.octet_length(item_text), F.lit(0))
    bench = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text"), size.alias("size"))
    shared = lambda block: docs.sparkSession.sparkContext.broadcast(Windows(block, n))  # noqa: E731 -- each Python worker reads it once
    out, block = docs, Block()
    for row in bench.toLocalIterator():
        if block.full(row.size, block_bytes):
            out = cut(out.mapInArrow(_scan(text, shared(block), names), T.StructType([docs.schema[c] for c in names] + list(_ROW))), "decontaminate")
            block = Block()
        block.add(row.id, (row.text or "").encode())
    return out, shared(block)


def contaminated():
    """Whether any word is hit and hit words are a twentieth of all words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated documents, its columns as they were."""
    return scan(docs, benchmark, **options).where(~contaminated()).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", longest: int | None = None, **options) -> DataFrame:
    """``docs`` with the hit spans cut out of the texts; a null text becomes empty. With ``longest``, contaminated documents and
    those with so many hit words in a row go."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in _ROW.names}  # a caller's columns named like results
    held = docs.withColumnsRenamed(aside)
    rows, shared = _last(held, benchmark, text, **options)
    return rows.mapInArrow(_strip(text, shared, held.columns, longest), held.schema).withColumnsRenamed({v: k for k, v in aside.items()})


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, **options) -> DataFrame:
    """``docs`` without those that hold ``n`` hit words in a row or are contaminated, and the others without their hit
    spans (items of fewer than ``n`` words, which a clean text may have by chance), from one scan; a null text becomes empty."""
    return remove_spans(docs, benchmark, n=n, longest=n, **options)


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """The scan's counts, the found items' digest and the verdict."""
    return scanned.select(
        *keep, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
