"""Removal of byte strings that an earlier document has too, by a distributed sort of sampled suffixes.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. Sorting every
suffix isn't needed: of the ``GRAM``-byte grams within each such string the one of least hash (the leftmost, if several) is
sampled, and equal strings sample the same place, so equal strings meet at a sampled suffix.

1. Texts are packed into chunks, written to the shared folder. Exact copies of an earlier document are known by digest
and sampled no more. 2. Each chunk gives the distinct hashes of its samples to their bucket, which answers with those
that another document has. 3. Each chunk sorts the suffixes of these samples, cut to ``LENGTH`` bytes, into one run per
bucket, those of many buckets at once, front-coded: the prefix shared with the suffix before is a number. The text left of each is payload. Of equal
contexts within a chunk only the smallest document's go on; the others' removal is known already. 4. A bucket merges its
runs with a loser tree that compares two suffixes only behind the prefix that both are known to share with the last
one put out. From the merged order and its common prefixes follows, for each place of the sample within a string, which
suffixes have equal strings there, and the smallest document among them; all strings of one sample that go make one span,
as each covers the sample. A gram with more than ``HOT`` samples isn't merged, as all of it would meet in one task: its strings
are dealt out one by one (by 96-bit hashes), and the smallest document with each is found. 5. Spans return to their chunks, where the remaining bytes are digested.

Defined results: a null text counts as empty; a null doc_id takes no part and keeps its text; documents with equal ids are
never earlier than each other; empty tables have no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import chunks as packed
from .chunks import Chunk, bucket_of, deltas, later_copies, pack, rows_of, spread, squeeze
from .common import cut

LENGTH, GRAM = 50, 16
#: Grams within a string, and so the most bytes of it left of its sample, plus one.
PLACES = LENGTH - GRAM + 1
STEP = 256 << 10
#: Low bits of a hash that give way to the place, wherever a text stands: the same strings always sample the same place.
PLACE_BITS = 24
#: Samples of one gram that a merge takes; a more frequent gram's strings are dealt out by themselves.
HOT = 4096
#: Packed chunks that make one here, and a bucket's share of them. Each chunk writes to each bucket, so cells grow with the
#: square of the table; with four times the bytes they are a sixteenth.
WIDE = 4
#: Samples whose suffixes a chunk sorts at a time, for as many buckets as they are in; a bucket of more is sorted whole.
SORTED = 1 << 15

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def sample(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the sampled grams of the documents that ``starts`` bound in ``data``."""
    n, ends = len(data), starts[1:]
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    if n > 1 << PLACE_BITS:  # one long document: in pieces, each string in one of them
        size = 1 << PLACE_BITS
        parts = [(at, *sample(data[at : at + size], np.array([0, min(size, n - at)]))) for at in range(0, n - LENGTH + 1, size - LENGTH + 1)]
        places, first = np.unique(np.concatenate([at + p for at, p, _ in parts]), return_index=True)
        return places, np.concatenate([h for _, _, h in parts])[first]
    word = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(_U)
    for k in (1, 2, 4):
        word = word[:-k] | word[k:] << _U(8 * k)
    hashes = _mix(word[:n] * _U(0x9E3779B97F4A7C15) + _mix(word[8 : n + 8]))
    bits = _U(PLACE_BITS)
    least = (hashes >> bits << bits) | np.arange(n, dtype=_U)
    width, done = 1, least
    while 2 * width <= PLACES:
        done = np.minimum(done[:-width], done[width:])
        width *= 2
    if width < PLACES:
        done = np.minimum(done[: n - PLACES + 1], done[PLACES - width : n - width + 1])
    whole = np.zeros(n + 1, np.int32)  # strings that begin here end within their document
    long = ends - starts[:-1] >= LENGTH
    np.add.at(whole, starts[:-1][long], 1)
    np.add.at(whole, (ends - LENGTH + 1)[long], -1)
    done = done[: n - LENGTH + 1][np.cumsum(whole[: n - LENGTH + 1]) > 0]
    taken = np.zeros(n, bool)
    taken[(done & ((_U(1) << bits) - _U(1))).astype(np.int64)] = True
    places = np.flatnonzero(taken)
    return places, _mix(hashes[places])  # a sample's hash is the least of many; mixed anew, such hashes spread over all buckets


def samples(held: Chunk, skip: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's index, place in the chunk, hash) of each sample outside the documents to skip."""
    out, i, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))], 0, len(held.ids)
    while i < n:
        j = max(i + 1, int(np.searchsorted(held.starts, held.starts[i] + STEP, side="right")) - 1)
        base = held.starts[i]
        places, hashes = sample(held.data[base : held.starts[j]], held.starts[i : j + 1] - base)
        out.append((np.searchsorted(held.starts, places + base, side="right") - 1, places + base, hashes))
        i = j
    docs, places, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    if skip:
        kept = ~np.isin(docs, np.fromiter(skip, np.int64))
        docs, places, hashes = docs[kept], places[kept], hashes[kept]
    return docs, places, hashes


def _ask(buckets: int):
    """A chunk's distinct sample hashes by bucket, how often it has each (up to 127), and (128) whether several documents do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, copies in rows_of(batches, "chunk", "data", "copies"):
            held = Chunk.load(data)
            docs, _, hashes = samples(held, set(copies or ()))
            if not len(hashes):
                continue
            order = np.lexsort((held.ids[docs], hashes))
            ids, hashes = held.ids[docs][order], hashes[order]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            last = np.append(first[1:], len(hashes)) - 1
            times = (np.minimum(last - first + 1, 127) | np.where(ids[last] != ids[first], 128, 0)).astype(np.uint8)
            hashes = hashes[first]
            which = bucket_of(hashes, buckets)
            bounds = np.searchsorted(which, np.arange(buckets + 1))
            rows = [(b, squeeze(deltas(hashes[i:j]), times[i:j])) for b, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if j > i]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "chunk", "asked"])

    return run


def _answer(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """The hashes that two documents or more have, for each chunk that has them, and whether they are hot."""
        chunks, parts = table.column("chunk").to_pylist(), [spread(v) for v in table.column("asked").to_pylist()]
        own = [np.cumsum(p[0], dtype=_U) for p in parts]
        _, which, chunks_with = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        times = np.concatenate([p[1] for p in parts])
        total = np.bincount(which, weights=times & 127)[which]
        shared = np.bincount(which, weights=times >> 7)[which] + chunks_with[which] > 1
        at, rows = 0, []
        for chunk, mine in zip(chunks, own, strict=True):
            found, often = shared[at : at + len(mine)], total[at : at + len(mine)] > hot
            at += len(mine)
            if found.any():
                rows.append((chunk, squeeze(deltas(mine[found]), np.packbits(often[found]))))
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "shared": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _spans_of(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most bytes left of a sample in its document's strings, given what is left and right of it."""
    return np.maximum(0, LENGTH - right), np.minimum(PLACES - 1, left)


def _runs(buckets: int):
    """A chunk's front-coded sorted runs of shared samples' suffixes, and spans that are known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, data, copies, answers in rows_of(batches, "chunk", "data", "copies", "answers"):
            held = Chunk.load(data)
            docs, places, hashes = samples(held, set(copies or ()))
            told = [spread(a) for a in answers]
            wanted, often = np.concatenate([np.cumsum(t[0], dtype=_U) for t in told]), np.concatenate([np.unpackbits(t[1], count=len(t[0])).view(bool) for t in told])
            order = np.argsort(wanted)
            wanted, often = wanted[order], often[order]
            near = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            found = wanted[near] == hashes
            docs, places, hashes, often = docs[found], places[found], hashes[found], often[near[found]]
            if often.any():
                yield from _dealt(chunk, buckets, held, docs[often], places[often])
                docs, places, hashes = docs[~often], places[~often], hashes[~often]
            which = bucket_of(hashes, buckets)
            order = np.argsort(which, kind="stable")
            which, docs, places = which[order], docs[order], places[order]
            padded, i = np.concatenate([np.zeros(PLACES, np.uint8), held.data, np.zeros(LENGTH, np.uint8)]), 0
            while i < len(which):
                j = int(np.searchsorted(which, which[min(i + SORTED, len(which)) - 1], side="right"))
                yield _sorted(chunk, which[i:j], held, padded, docs[i:j], places[i:j])
                i = j

    return run


def _strings(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of the string at each start."""
    padded, keys, checks = np.concatenate([data, np.zeros(8, np.uint8)]), [np.zeros(0, _U)], [np.zeros(0, np.uint32)]
    for at in range(0, len(starts), 1 << 16):
        rows = padded[starts[at : at + (1 << 16), None] + np.arange(-(-LENGTH // 8) * 8)]
        rows[:, LENGTH:] = 0
        one, two = np.zeros(len(rows), _U), np.full(len(rows), LENGTH, _U)
        for word in rows.view(_U).T:
            one, two = _mix(one * _U(0x9E3779B97F4A7C15) + word), _mix((two ^ word) * _U(0xD6E8FEB86659FD93))
        keys.append(one)
        checks.append((two >> _U(32)).astype(np.uint32))
    return np.concatenate(keys), np.concatenate(checks)


def _dealt(chunk: int, buckets: int, held: Chunk, docs: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The strings about samples of hot grams, by bucket of the whole string, and the spans that are known to go.

    A hot gram's suffixes would all meet in one merge, since what is around a passage differs from document to document.
    Its strings are as many as the texts' bytes about it at most, and their keys spread over all buckets.
    """
    low, high = _spans_of(np.minimum(PLACES - 1, places - held.starts[docs]), np.minimum(LENGTH, held.starts[docs + 1] - places))
    count = np.maximum(0, high - low + 1)
    back = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.unique(np.repeat(places, count) - back)
    docs = np.searchsorted(held.starts, starts, side="right") - 1
    owner, (keys, checks) = held.ids[docs], _strings(held.data, starts)
    order = np.lexsort((starts, owner, checks, keys))
    keys, checks, owner, docs, starts = (x[order] for x in (keys, checks, owner, docs, starts))
    begin = starts - held.starts[docs]
    known = owner > _least(keys, checks, owner)
    spans = np.stack([docs[known], begin[known], begin[known] + LENGTH], 1).astype(np.int64)
    spans = _joined(spans)
    keys, checks, owner, docs, begin = (x[~known] for x in (keys, checks, owner, docs, begin))
    bounds = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        i, j = bounds[b], bounds[b + 1]
        value = squeeze(deltas(keys[i:j]), checks[i:j], owner[i:j], docs[i:j].astype(np.int32), begin[i:j].astype(np.int64), spans.ravel())
        spans = spans[:0]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - b], pa.int64()), pa.array([chunk], pa.int64()), pa.array([value], pa.binary())], names=["bucket", "chunk", "run"])


def _least(keys: np.ndarray, checks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first owner of each sorted row's string."""
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])))
    return np.repeat(owner[first], np.diff(np.append(first, len(keys))))


def _joined(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans (document, start, end; all of one length) as one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    new = np.append(True, (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] > spans[:-1, 2]))
    first = np.flatnonzero(new[: len(spans)])
    return np.stack([spans[first, 0], spans[first, 1], spans[np.append(first[1:], len(spans)) - 1, 2]], 1) if len(spans) else spans


def _agreed(table: pa.Table) -> pa.Table:
    """The spans of one bucket's hot strings that a smaller document has too, by chunk."""
    chunks, parts = table.column("chunk").to_pylist(), [spread(v) for v in table.column("run").to_pylist()]
    keys = np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts])
    checks, owner = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    order = np.lexsort((owner, checks, keys))
    gone = np.empty(len(keys), bool)
    gone[order] = owner[order] > _least(keys[order], checks[order], owner[order])
    at, rows = 0, []
    for chunk, (gaps, _, _, docs, begin, known) in zip(chunks, parts, strict=True):
        mine = gone[at : at + len(gaps)]
        at += len(gaps)
        spans = np.concatenate([known.reshape(-1, 3), np.stack([docs[mine], begin[mine], begin[mine] + LENGTH], 1).astype(np.int64)])
        if len(spans):
            rows.append((chunk, squeeze(spans[np.lexsort((spans[:, 1], spans[:, 0]))].ravel())))
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "spans": pa.array([r[1] for r in rows], pa.binary())})


def _sorted(chunk: int, which: np.ndarray, held: Chunk, padded: np.ndarray, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """The runs of the buckets in ``which`` (ascending), sorted at once: arrays for each of many small runs take most of the time."""
    right = np.minimum(LENGTH, held.starts[docs + 1] - places)
    left = np.minimum(PLACES - 1, places - held.starts[docs])
    rows = padded[places[:, None] + np.arange(-(PLACES - 1), LENGTH) + PLACES]
    reach = np.arange(-(PLACES - 1), LENGTH)
    rows[(reach < -left[:, None]) | (reach >= right[:, None])] = 0
    tails = np.ascontiguousarray(rows[:, PLACES - 1 :])
    heads = np.ascontiguousarray(rows[:, : PLACES - 1][:, ::-1])
    owner = held.ids[docs]
    order = np.lexsort((owner, left, heads.view(f"S{PLACES - 1}").ravel(), right, tails.view(f"S{LENGTH}").ravel(), which))
    tails, heads, owner, docs, places, left, right, which = (x[order] for x in (tails, heads, owner, docs, places, left, right, which))
    new = np.append(True, (tails[1:] != tails[:-1]).any(1) | (heads[1:] != heads[:-1]).any(1) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    least = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    known = owner > least
    low, high = _spans_of(left, right)
    gone = known & (low <= high)
    begin = places - held.starts[docs]
    spans = np.stack([docs[gone], (begin - high)[gone], (begin - low + LENGTH)[gone]], 1).astype(np.int64)
    tails, heads, owner, docs, begin, left, right, which = (x[~known] for x in (tails, heads, owner, docs, begin, left, right, which))
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    common = np.zeros(len(tails), np.int64)
    differs = tails[1:] != tails[:-1]
    common[1:] = np.where(differs.any(1), differs.argmax(1), LENGTH)
    common[first] = 0
    rest = tails[np.arange(LENGTH) >= common[:, None]]
    before = heads[np.arange(PLACES - 1) < left[:, None]]
    ends = [np.append(x[first], x[-1]).tolist() for x in (np.arange(len(tails) + 1), np.append(0, np.cumsum(LENGTH - common)), np.append(0, np.cumsum(left)))]
    common, left, right, docs, begin, spans = common.astype(np.uint8), left.astype(np.uint8), right.astype(np.uint8), docs.astype(np.int32), begin.astype(np.int64), spans.ravel()
    values = []
    for i, j, r, to, b, end in zip(ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:], ends[2][:-1], ends[2][1:], strict=True):
        values.append(squeeze(common[i:j], rest[r:to], before[b:end], left[i:j], right[i:j], owner[i:j], docs[i:j], begin[i:j], spans))
        spans = spans[:0]
    return pa.RecordBatch.from_arrays([pa.array(which[first], pa.int64()), pa.array([chunk] * len(values), pa.int64()), pa.array(values, pa.binary())], names=["bucket", "chunk", "run"])


def unfold(common: list[int], rest: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, last, at = [], b"", 0
    for c in common:
        last = last[:c] + rest[at : at + LENGTH - c]
        at += LENGTH - c
        out.append(last)
    return out


def merge(runs: list[list[bytes]], commons: list[list[int]]) -> tuple[list[int], list[int]]:
    """A loser tree over sorted runs, each with its suffixes' common prefixes with the one before.

    Gives the merged order as places in the joined runs, and each suffix's common prefix with the one before it. Every
    waiting head keeps the length of the prefix it shares with what beat it, so two heads are compared only behind
    the shorter of theirs, and not at all where the lengths differ.
    """
    k = len(runs)
    bases = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).tolist()
    at, heads = [0] * k, [r[0] if r else None for r in runs]
    shared = [0 if r else -1 for r in runs]  # -1: the run has ended
    tree = [-1] * k
    order, common = [], []
    number = int.from_bytes

    def play(run: int, node: int) -> int:
        """``run`` climbs from ``node``; the winner comes out at the top."""
        while node:
            other = tree[node]
            if other < 0:
                tree[node] = run
                return -1
            mine, its = shared[run], shared[other]
            if mine == its:
                if mine >= 0:
                    a, b = heads[run], heads[other]
                    x, y = a[mine:], b[mine:]
                    if x == y:
                        both = LENGTH
                    else:
                        both = mine + len(x) - ((number(x) ^ number(y)).bit_length() + 7) // 8
                    if x < y or x == y and run < other:
                        shared[other] = both
                    else:
                        shared[run] = both
                        tree[node], run = run, other
            elif mine < its:
                tree[node], run = run, other
            node >>= 1
        return run

    winner = 0
    for run in range(k):
        winner = play(run, (run + k) >> 1)
    while shared[winner] >= 0:
        i = at[winner]
        order.append(bases[winner] + i)
        common.append(shared[winner])
        i += 1
        if i < len(runs[winner]):
            at[winner], heads[winner], shared[winner] = i, runs[winner][i], commons[winner][i]
        else:
            shared[winner] = -1
        if k > 1:
            winner = play(winner, (winner + k) >> 1)
    return order, common


def _merged(table: pa.Table) -> pa.Table:
    """The spans to remove, by chunk, from one bucket's runs, or from its hot strings."""
    if table.column("bucket")[0].as_py() < 0:
        return _agreed(table)
    chunks = table.column("chunk").to_pylist()
    parts = [spread(v) for v in table.column("run").to_pylist()]
    commons = [p[0].tolist() for p in parts]
    order, common = merge([unfold(c, p[1].tobytes()) for c, p in zip(commons, parts, strict=True)], commons)
    out = [p[8].reshape(-1, 3) for p in parts]
    if order:
        order, common = np.array(order), np.array(common)
        left, right, owner, docs, begin = (np.concatenate([p[k] for p in parts])[order] for k in (3, 4, 5, 6, 7))
        left, right = left.astype(np.int64), right.astype(np.int64)
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])[order]
        heads = np.zeros((len(order), PLACES - 1), np.uint8)
        lengths = np.concatenate([p[3] for p in parts])
        heads[np.arange(PLACES - 1) < lengths[:, None]] = np.concatenate([p[2] for p in parts])
        heads = heads[order]
        low, high = np.full(len(order), PLACES), np.full(len(order), -1)
        sideways = np.argsort(heads.view(f"S{PLACES - 1}").ravel(), kind="stable")
        differs = heads[sideways[1:]] != heads[sideways[:-1]]
        alike = np.append(0, np.where(differs.any(1), differs.argmax(1), PLACES))  # common left contexts, in their order
        before = np.empty(len(order), np.int64)
        for j in range(PLACES):
            group = np.cumsum(common < LENGTH - j)  # equal to the right of the sample as far as the string goes
            before[sideways] = np.cumsum(alike < j)  # and to the left
            fits = np.flatnonzero((left >= j) & (right >= LENGTH - j))
            if not len(fits):
                continue
            key = group[fits] * (len(order) + 1) + before[fits]
            by = np.lexsort((owner[fits], key))
            key, place = key[by], fits[by]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            least = np.repeat(owner[place[first]], np.diff(np.append(first, len(key))))
            gone = place[owner[place] > least]
            high[gone] = j
            low[gone] = np.minimum(low[gone], j)
        gone = np.flatnonzero(high >= 0)
        gone = gone[np.argsort(source[gone], kind="stable")]
        spans = np.stack([docs[gone], (begin - high)[gone], (begin - low + LENGTH)[gone]], 1).astype(np.int64)
        bounds = np.searchsorted(source[gone], np.arange(len(parts) + 1)).tolist()
        out = [np.concatenate([known, spans[i:j]]) for known, i, j in zip(out, bounds[:-1], bounds[1:], strict=True)]
    rows = [(c, squeeze(s.ravel())) for c, s in zip(chunks, out, strict=True) if len(s)]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "spans": pa.array([r[1] for r in rows], pa.binary())})


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, copies, found in rows_of(batches, "data", "copies", "found"):
            held, rows = Chunk.load(data), []
            copied = set(copies or ())
            spans = np.concatenate([np.zeros((0, 3), np.int64), *(spread(s)[0].reshape(-1, 3) for s in found or ())])
            spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
            bounds = np.searchsorted(spans[:, 0], np.arange(len(held.ids) + 1))
            for d, doc in enumerate(held.ids.tolist()):
                text = held.data[held.starts[d] : held.starts[d + 1]].tobytes()
                runs: list[list[int]] = [[0, len(text)]] if d in copied and len(text) >= LENGTH else []
                if not runs:
                    for _, i, j in spans[bounds[d] : bounds[d + 1]].tolist():
                        if runs and i <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], j)
                        else:
                            runs.append([i, j])
                cuts = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))
                rows.append((doc, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4 + (pa.string(), pa.binary()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_text], names=names[: 5 + with_text])

    return run


def remove(docs: DataFrame, *, text: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, kept (bytes)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = pack(rows, "chunks", WIDE * packed.CHUNK)
    buckets = max(32, chunks.count())
    held = chunks.select("chunk", "data").join(later_copies(chunks), "chunk", "left")
    asked = held.mapInArrow(_ask(buckets), "bucket long, chunk long, asked binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer(hot), "chunk long, shared binary").groupBy("chunk").agg(F.collect_list("shared").alias("answers"))
    runs = held.join(cut(answers, "answers"), "chunk").mapInArrow(_runs(buckets), "bucket long, chunk long, run binary")
    found = runs.groupBy("bucket").applyInArrow(_merged, "chunk long, spans binary").groupBy("chunk").agg(F.collect_list("spans").alias("found"))
    schema = _RESULT + (", kept binary" if with_text else "")
    out = held.join(cut(found, "spans"), "chunk", "left").mapInArrow(_finish(with_text), schema)
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    rest = rows.where("doc_id is null").select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "utf-8").alias("kept")] if with_text else []))
    return out.unionByName(rest)
