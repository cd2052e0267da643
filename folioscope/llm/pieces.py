"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that some piece spells, ordered by the piece's score and then from the
left, and merges until it is empty. No piece has white space behind another character, and none but the line feed's
byte has a line feed, so a text falls into units (a run of spaces with the word behind it, or a line feed with the word
behind it) that no merge crosses. The agendas of an Arrow batch's new units advance together, one merge of each per
round; a unit of more than ``LONG`` symbols has a heap of its own. Encoded units are kept, up to a bounded number.

Each text is checked against the sentencepiece library: that it reads the same characters of the whole text, and, as no merge
crosses units, that it has the same ids for each unit; it encodes a unit once as long as that is kept. The agenda's ids are
the result in any case; ``differs`` says where the library has others, so that a caller can refuse them.

Defined results: a null or empty text is the end id alone and decodes to an empty text; repeated rows each get their own
result; extra columns pass through, and those named like results are replaced.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import keeps, steps

LONG = 128
#: Units a worker keeps in each of two generations, so that frequent units outlive the rare.
KEPT = 250_000
ID = np.dtype("<i4")
SPACE = "▁"
_NONE = np.iinfo(np.int32).max
#: Marks that a unit may end with, and which are encoded by themselves where no piece joins one to what is before it.
_MARKS = ".,;:!?"
_SPREAD = 0x9E3779B97F4A7C15
_UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*")


class Pieces:
    """A vocabulary's pairs, and what has been encoded with it so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.piece = {sp.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.piece) or any(map(sp.is_unused, plain)):
            raise ValueError("the vocabulary has pieces across words, or unused ones")
        self.end = sp.eos_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size, self.symbols, self.extra = size, dict(self.piece), []
        best = sorted({sp.get_score(i) for i in self.piece.values()}, reverse=True)
        order = {s: k for k, s in enumerate(best)}
        pairs: dict[int, tuple[int, int]] = {}  # left << 32 | right: the merged piece's rank and id
        for text, i in self.piece.items():
            for cut in range(1, len(text)):
                left, right = self._symbol(text[:cut]), self._symbol(text[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[sp.get_score(i)], i)
        self.pairs = pairs
        self._lay_out(pairs)
        self.feed = ID.itemsize  # of a line feed's id
        #: Neighbouring characters within pieces, as code points: no merge goes across any others.
        self.joined = {(a, b) for text in self.piece for a, b in zip(text, text[1:])}
        #: Symbols by code point; -1 where none has been given yet.
        self.table = np.full(0x110000, -1, np.int32)
        for text, i in self.symbols.items():
            if len(text) == 1:
                self.table[ord(text)] = i
        self.table[ord(SPACE)] = self.table[ord(" ")] = self._symbol(SPACE)  # within a unit a space is one of the text's
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: The library's ids of units, in two generations as well, and how many stand for the space it puts before a text.
        self.right: dict[str, bytes] = {}
        self.old_right: dict[str, bytes] = {}
        self.lead = len(sp.encode("\n")) - 1
        self.decimal = [str(i) for i in range(size)]

    def _symbol(self, text: str) -> int | None:
        """A symbol's number: a piece's id, or one past the vocabulary for any other single character."""
        if text not in self.symbols and len(text) == 1:
            self.symbols[text] = self.size + len(self.extra)
            self.extra.append(text)
        return self.symbols.get(text)

    def _lay_out(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open table of the pairs' keys, a quarter full at most; the last slot stays empty and stands for no pair."""
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.last + 1, -1, np.int64)
        self.ranks, self.merged = np.full(self.last + 1, _NONE, np.int32), np.zeros(self.last + 1, np.int32)
        for key, (rank, merged) in pairs.items():
            at = (key * _SPREAD & (1 << 64) - 1) >> 64 - bits
            while self.keys[at] >= 0:
                at = (at + 1) % self.last
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, merged

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's slot in the table."""
        key = left << 32 | right
        at = (key.view(np.uint64) * np.uint64(_SPREAD) >> self.shift).astype(np.int64)
        out = np.full(len(key), self.last)
        which = np.arange(len(key))
        while len(which):
            held = self.keys[at]
            found = held == key
            out[which[found]] = at[found]
            more = ~found & (held >= 0)
            which, key, at = which[more], key[more], (at[more] + 1) % self.last
        return out

    def together(self, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of units of ``lengths``, one after the other, and their numbers by unit.

        All agendas give up their best pair in each round; a unit whose agenda is empty is set aside.
        """
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        slot = self._slot(symbol, np.append(symbol[1:], 0))
        slot[np.append(owner[1:] != owner[:-1], True)] = self.last
        while len(symbol):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            rank = self.ranks[slot]
            best, sizes = np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbol)))
            done = best == _NONE
            if done.any():
                over = np.repeat(done, sizes)
                ended.append((owner[over], symbol[over]))
                symbol, owner, rank, slot, best, sizes = symbol[~over], owner[~over], rank[~over], slot[~over], best[~done], sizes[~done]
                if not len(symbol):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # the leftmost of each unit
            symbol[hits] = self.merged[slot[hits]]
            slot[hits] = slot[hits + 1]  # no pair where the merged one ends its unit
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            place = hits - np.arange(len(hits))
            symbol, owner, slot = symbol[keep], owner[keep], slot[keep]
            follows = place[place + 1 < len(symbol)]
            before = place[place > 0] - 1
            near = np.concatenate([follows, before])
            near = near[owner[near] == owner[near + 1]]
            slot[near] = self._slot(symbol[near], symbol[near + 1])
        owners, symbols = (np.concatenate(x) for x in zip(*ended, strict=True))
        return symbols[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(lengths))

    def alone(self, unit: list[int]) -> list[int]:
        """The same for one long unit: a heap of pairs over a linked list."""
        symbol, n = list(unit), len(unit)
        left, right, agenda = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                found = self.pairs.get(symbol[i] << 32 | symbol[right[i]])
                if found:
                    heapq.heappush(agenda, (found[0], i, symbol[i], symbol[right[i]], found[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, merged = heapq.heappop(agenda)
            j = right[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j], right[i] = merged, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbol if s >= 0]

    def learn(self, units: list[str]) -> None:
        """Encodes units that aren't known yet."""
        every = "".join(units)
        mark = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if c not in every)
        points = np.frombuffer((mark + mark.join(units) + "\n").encode("utf-32-le"), "<u4")  # a mark before each unit
        heads = np.flatnonzero(points == ord(mark))
        first = points[heads + 1]
        bare = heads[((first == 10) | (first == 32)) & (np.diff(heads, append=len(points) - 1) > 1)]  # these have no space of their own before them
        row = self.table[points]
        row[heads] = self.table[ord(SPACE)]
        if (row < 0).any():
            for point in np.unique(points[row < 0]).tolist():
                self.table[point] = self._symbol(chr(point))
            row = np.where(row < 0, self.table[points], row)
        keep = np.ones(len(points), bool)
        keep[bare] = keep[-1] = False
        row = row[keep]
        starts = np.cumsum(keep)[heads] - keep[heads]
        lengths = np.diff(starts, append=len(row))
        odd = np.add.reduceat(row >= self.size, starts) > 0
        long = lengths > LONG
        if long.any():
            for k in np.flatnonzero(long).tolist():
                self.known[units[k]] = self._bytes(np.array(self.alone(row[starts[k] : starts[k] + lengths[k]].tolist()), np.int64), bool(odd[k]))
            units = [u for u, is_long in zip(units, long.tolist(), strict=True) if not is_long]
            row, odd, lengths = row[np.repeat(~long, lengths)], odd[~long], lengths[~long]
        if units:
            symbols, sizes = self.together(row.astype(np.int64), lengths)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat, cuts = symbols.astype(ID).tobytes(), (bounds * ID.itemsize).tolist()
            self.known.update(zip(units, [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
            for n in np.flatnonzero(odd).tolist():
                self.known[units[n]] = self._bytes(symbols[bounds[n] : bounds[n + 1]], True)

    def _bytes(self, symbols: np.ndarray, odd: bool) -> bytes:
        """Ids of final symbols; a character outside the vocabulary is spelt in its UTF-8 bytes."""
        if odd:
            symbols = np.array([i for s in symbols.tolist() for i in ([s] if s < self.size else map(self.bytes.__getitem__, self.extra[s - self.size].encode()))])
        return symbols.astype(ID).tobytes()

    def units(self, text: str) -> list[str]:
        """The keys of a text's units: a word that one space goes before, or white space with the word behind it."""
        if not text:
            return []
        words = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
        if "" not in words:
            return words
        found = _UNIT.findall(" " + text.replace(SPACE, " "))
        return [u if u[0] == "\n" or u[:2] == "  " else u[1:] for u in found]

    def _recalled(self, new: set[str]) -> set[str]:
        """Those of ``new`` that the generation before doesn't have either."""
        if both := new.intersection(self.old):
            self.known.update(zip(both, map(self.old.__getitem__, both), strict=True))
            new = new.difference(both)
        return new

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids, with the end id."""
        return self.ids_of([self.units(t) for t in texts])

    def ids_of(self, cut: list[list[str]]) -> Iterator[np.ndarray]:
        """The ids of texts that are cut into units, with the end id."""
        if len(self.known) > KEPT:
            self.known, self.old = {}, self.known
        new = self._recalled(set().union(*cut).difference(self.known))
        ended = []
        for unit in new:
            if unit[-1:] in _MARKS and (core := unit.rstrip(_MARKS)) and core[-1] not in " \n" and (core[-1], unit[len(core)]) not in self.joined:
                ended.append((unit, core, "\n" + unit[len(core) :]))
        if ended:
            units, cores, marks = zip(*ended, strict=True)
            new = self._recalled(new.difference(units).union(cores, marks).difference(self.known))
        if new:
            self.learn(list(new))
        known = self.known
        for unit, core, mark in ended:
            known[unit] = known[core] + known[mark][self.feed :]
        get, end = self.known.__getitem__, np.array([self.end], ID).tobytes()
        for units in cut:
            yield np.frombuffer(b"".join([*map(get, units), end]), ID)

    def differing(self, texts: list[str], cut: list[list[str]]) -> Iterator[bool]:
        """Whether the library reads other characters of a text, or has other ids for its units than ``ids_of`` just gave."""
        if len(self.right) > KEPT:
            self.right, self.old_right = {}, self.right
        every = set().union(*cut)
        new = every.difference(self.right)
        if both := new.intersection(self.old_right):
            self.right.update(zip(both, map(self.old_right.__getitem__, both), strict=True))
            new = new.difference(both)
        if new:
            units = list(new)
            found = self.library.encode([u[1:] if u[:2] == "  " else u or "\n" for u in units], num_threads=1)
            found = [ids[self.lead :] if u[:1] == "\n" else ids if u else ids[: self.lead] for u, ids in zip(units, found, strict=True)]
            flat, at = np.fromiter(chain.from_iterable(found), ID).tobytes(), 0
            for unit, ids in zip(units, found, strict=True):
                value, own = flat[at : at + len(ids) * ID.itemsize], self.known[unit]
                self.right[unit] = own if own == value else value  # kept once
                at += len(value)
        units = list(every)
        wrong = {u for u, own, right in zip(units, map(self.known.__getitem__, units), map(self.right.__getitem__, units), strict=True) if own != right}
        for text, units, read in zip(texts, cut, self.library.normalize(texts), strict=True):
            yield read != (SPACE + text.replace(" ", SPACE) if text else "") or bool(wrong) and not wrong.isdisjoint(units)

    def spell(self, ids: list[int]) -> str:
        return " ".join(map(self.decimal.__getitem__, ids))


@lru_cache(1)
def _pieces(path: str) -> Pieces:
    keeps("pieces", _pieces.cache_clear)
    return Pieces(path)


def coded(path: str, texts: list[str]) -> Iterator[tuple[list[int], str, bool]]:
    """(ids, the decoded text, whether the library has other ids) of each text."""
    pieces = _pieces(path)
    cut = [pieces.units(t) for t in texts]
    own = [ids.tolist() for ids in pieces.ids_of(cut)]
    decoded = pieces.library.decode(own, num_threads=1)
    yield from zip(own, decoded, pieces.differing(texts, cut), strict=True)


def _run(text: str, keep: list[str], path: str, digests: bool):
    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        rows, spell = list(coded(path, [t or "" for t in batch.column(text).to_pylist()])), _pieces(path).spell
        differs = pa.array([r[2] for r in rows], pa.bool_())
        if digests:
            more = {"n_tokens": pa.array([len(r[0]) for r in rows], pa.int64()), "ids_sha256": pa.array([sha(spell(r[0])) for r in rows]), "decoded_sha256": pa.array([sha(r[1]) for r in rows]), "differs": differs}
        else:
            more = {"ids": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "decoded": pa.array([r[1] for r in rows]), "differs": differs}
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], names=[*keep, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of numbers live for one step, and none is in a cycle
        try:
            yield from map(rows_of, steps(batches, text, operator="pieces"))
        finally:
            gc.enable()

    return run


_CODED = (T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("differs", T.BooleanType()))
_DIGESTS = (T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("differs", T.BooleanType()))


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ids and decoded, or with ``digests`` their count and digests alone."""
    fields = _DIGESTS if digests else _CODED
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in fields}]
    rows = docs.select(*dict.fromkeys([*names, text]))
    return rows.mapInArrow(_run(text, names, path, digests), T.StructType([*(rows.schema[c] for c in names), *fields]))
