"""Packing a document's lines into passages of a token budget, cutting at the best boundary in reach.

A cut is looked for at the strongest break first: section or page, list item, sentence; the passage must be filled to
``floor`` of the budget. Without any, the last line that fits is the cut. A line longer than the budget is a passage of
its own. ``overlap`` repeats trailing lines of up to so many tokens, at most half of a passage's lines, from a line that
follows a sentence's end. Every line is in exactly one passage as its own (not repeated) line, and none is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import layout

TARGET, FLOOR, OVERLAP = 512, 0.332, 0
#: Bytes of lines that are Python objects at once; bounds a worker's memory whatever a batch holds.
STEP = 1 << 20
_SCHEMA = "doc_id long, i int, text string, n_tokens int, first int, last int, pages array<int>"


def tokens(line: str) -> int:
    return len(line.split())


def pack(rows: list[tuple[int, int, str, int]], target: int = TARGET, overlap: int = OVERLAP, floor: float = FLOOR, boundaries: bool = True) -> list[tuple[int, int, int]]:
    """(first repeated, first own, end) of each passage over rows of (seq, page, line, strength of the break before)."""
    sizes, out, at = [tokens(r[2]) for r in rows], [], 0
    carried = 0
    while at < len(rows):
        total, end = sum(sizes[carried:at]), at
        while end < len(rows) and (end == at or total + sizes[end] <= target):
            total += sizes[end]
            end += 1
        if end < len(rows) and boundaries:
            filled, best = sum(sizes[carried:at]), (0, end)
            for k in range(at + 1, end + 1):
                filled += sizes[k - 1]
                strength = rows[k][3] if k < len(rows) else 3
                if filled >= floor * target and strength and strength >= best[0]:
                    best = (strength, k)
            end = best[1]
        out.append((carried, at, end))
        carried, at = _carry(rows, sizes, at, end, overlap), end
    return out


def _carry(rows, sizes: list[int], start: int, end: int, overlap: int) -> int:
    held, k = 0, end
    while overlap and k - 1 > start and held + sizes[k - 1] <= overlap and (end - k + 1) * 2 <= end - start:
        k -= 1
        held += sizes[k]
    while k < end and rows[k][3] == 0:
        k += 1
    return k if k < end else end


def steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[int], pa.StructArray]]:
    """Ids, numbers of lines and lines of some documents at a time, with ``STEP`` bytes of lines at most; a longer document stands alone."""
    lines, ids = batch.column("rows").flatten(), batch.column("doc_id")
    ends = np.cumsum(pc.list_value_length(batch.column("rows")).to_numpy())
    upto = np.append(0, np.cumsum(pc.binary_length(lines.field("line")).to_numpy(), dtype=np.int64))[ends]
    at = 0
    while at < len(ends):
        first, held = (ends[at - 1], upto[at - 1]) if at else (0, 0)
        to = max(at + 1, int(np.searchsorted(upto, held + STEP, side="right")))
        yield ids.slice(at, to - at), np.diff(ends[at:to], prepend=first).tolist(), lines.slice(first, ends[to - 1] - first)
        at = to


def passages(rows: DataFrame, target: int = TARGET, overlap: int = OVERLAP, floor: float = FLOOR, boundaries: bool = True) -> DataFrame:
    """doc_id, i, text, n_tokens, first and last seq, pages of each passage of each document.

    ``rows`` are lines with breaks. A document's lines are gathered as one array, which its text already was; a worker
    unpacks ``STEP`` bytes of them at a time.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "page", "line", "strength")))
    held = rows.groupBy("doc_id").agg(ordered.alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, lines in steps(batch):
                items, out, start = list(zip(*(lines.field(c).to_pylist() for c in ("seq", "page", "line", "strength")), strict=True)), [], 0
                for doc, size in zip(docs.to_pylist(), sizes, strict=True):
                    own = items[start : start + size]
                    start += size
                    for i, (carried, at, end) in enumerate(pack(own, target, overlap, floor, boundaries)):
                        part = own[carried:end]
                        out.append((doc, i, "\n".join(p[2] for p in part), sum(tokens(p[2]) for p in part), own[at][0], own[end - 1][0], sorted({p[1] for p in part})))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
                    names = ["doc_id", "i", "text", "n_tokens", "first", "last", "pages"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return held.mapInArrow(run, _SCHEMA)


def of_documents(documents: DataFrame, **options) -> DataFrame:
    return passages(layout.breaks(layout.lines(documents)), **options)
