"""Token ids in shard files: one wavelet matrix each, compressed, with document bounds.

Documents are dealt over range partitions in ascending doc_id order and encoded with the tokenizers library. White space
ends every token of these vocabularies' pre-tokenizers, so distinct words are encoded once and kept, up to a bounded
number; lower-casing, which their normaliser does anyway, and parting the marks at a word's end make fewer of them. Arrow finds
a step's distinct words and puts their ids in the texts' order, so that Python meets each of them once a step. A shard holds the ids of consecutive documents as bit-planes from the highest bit down, each plane's sequence
stably parted by the bit above; planes carry counts of ones by block, so that a token's value, its count in a range and
its k-th place can be read from the shard without unfolding it. Shards are rows of a Parquet table that Spark commits:
a lost executor's part is written again by another.

Defined results: a null or empty text is the end id alone; null ids come first; rows with equal ids stand in the order
of their texts; an empty table gives an empty folder of shards; extra columns take no part.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import steps

MAGIC = b"WMX1"
#: Tokens from which a shard is closed, and bits that one rank count covers.
SHARD, BLOCK = 1 << 20, 512
#: Tokens whose places are worked on at once, so that they stay in a core's cache.
PLACES = 1 << 14
#: Words a worker keeps in each of two generations.
KEPT = 400_000


class Shard:
    """A wavelet matrix over ``ids`` with the bounds of the documents they belong to."""

    def __init__(self, planes: np.ndarray, counts: np.ndarray, zeros: np.ndarray, n: int, docs: np.ndarray, nulls: np.ndarray, ends: np.ndarray):
        self.planes, self.counts, self.zeros, self.n, self.docs, self.nulls, self.ends = planes, counts, zeros, n, docs, nulls, ends

    @classmethod
    def build(cls, ids: np.ndarray, bits: int, docs: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> Shard:
        n = len(ids)
        blocks = n // BLOCK + 1
        planes, counts, zeros = np.zeros((bits, blocks * BLOCK // 8), np.uint8), np.zeros((bits, blocks), np.uint32), np.zeros(bits, np.uint32)
        now = ids
        for k in range(bits):
            one = now & now.dtype.type(1 << (bits - 1 - k)) != 0
            packed = np.packbits(one)
            planes[k, : len(packed)] = packed
            ones = np.bitwise_count(planes[k].view(np.uint64)).reshape(blocks, -1).sum(1, dtype=np.uint32)
            counts[k] = np.cumsum(ones) - ones
            low = now[np.flatnonzero(~one)]  # by places: a mask costs a mispredicted branch a bit
            zeros[k] = len(low)
            now = np.concatenate([low, now[np.flatnonzero(one)]])
        return cls(planes, counts, zeros, n, docs, nulls, ends)

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes folded back from the lowest."""
        bits = len(self.planes)
        now = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n).view(bool)
            above, i, j = np.empty_like(now), 0, int(self.zeros[k])
            now[j:] |= now.dtype.type(1 << (bits - 1 - k))
            for at in range(0, self.n, PLACES):
                part = one[at : at + PLACES]
                low, high = np.flatnonzero(~part), np.flatnonzero(part)
                above[at : at + PLACES][low] = now[i : i + len(low)]
                above[at : at + PLACES][high] = now[j : j + len(high)]
                i, j = i + len(low), j + len(high)
            now = above
        return now

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        block, rest = divmod(i, BLOCK)
        at = block * BLOCK // 8
        part = self.planes[k, at : at + (rest + 7) // 8].copy()
        if rest % 8:
            part[-1] &= 0xFF << (8 - rest % 8) & 0xFF
        return int(self.counts[k, block]) + int(np.bitwise_count(part).sum())

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            ones, bit = self._ones(k, i), int(self.planes[k, i // 8] >> (7 - i % 8) & 1)
            i = int(self.zeros[k]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _down(self, token: int, i: int) -> int:
        for k in range(len(self.planes)):
            ones = self._ones(k, i)
            i = int(self.zeros[k]) + ones if token >> (len(self.planes) - 1 - k) & 1 else i - ones
        return i

    def count(self, token: int, start: int, end: int) -> int:
        """How often ``token`` stands in [start, end)."""
        return self._down(token, end) - self._down(token, start)

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the ``j``-th (from 0) ``bit`` in plane ``k``."""
        seen = self.counts[k].astype(np.int64) if bit else np.arange(self.counts.shape[1]) * BLOCK - self.counts[k]
        block = int(np.searchsorted(seen, j, side="right")) - 1
        at = block * BLOCK // 8
        found = np.unpackbits(self.planes[k, at : at + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(found == bit)[j - int(seen[block])])

    def occurrence(self, token: int, j: int) -> int:
        """The place of the ``j``-th (from 0) ``token``; an IndexError if there are fewer."""
        first = self._down(token, 0)
        if not 0 <= j < self._down(token, self.n) - first:
            raise IndexError(j)
        i = first + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def dump(self) -> bytes:
        parts = [x.tobytes() for x in (self.planes, self.counts, self.zeros, self.docs, self.nulls, self.ends)]
        head = json.dumps({"bits": len(self.planes), "n": self.n, "docs": len(self.docs)}).encode()
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
        return MAGIC + struct.pack("<I", len(head)) + head + body

    @classmethod
    def load(cls, data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        size = struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8 : 8 + size])
        body, at = zstandard.ZstdDecompressor().decompress(data[8 + size :]), 0
        bits, n, docs = head["bits"], head["n"], head["docs"]
        blocks, out = n // BLOCK + 1, []
        for kind, *shape in ((np.uint8, bits, blocks * BLOCK // 8), (np.uint32, bits, blocks), (np.uint32, bits), (np.int64, docs), (np.bool_, docs), (np.int64, docs)):
            length = int(np.prod(shape)) * np.dtype(kind).itemsize
            out.append(np.frombuffer(body, kind, int(np.prod(shape)), at).reshape(shape))
            at += length
        return cls(*out[:3], n, *out[3:])


#: Marks that are neither letters, digits, white space nor part of a special token.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


#: Byte-level spelling: a byte that Latin-1 doesn't print stands as the next free character from U+0100.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES = {b: 256 + k for k, b in enumerate(_UNSEEN)}
_SPACES = {chr(_BYTES[b]) for b in b" \n"}
#: The same as UTF-16 units by byte, but for the space between words.
_SPELT = np.array([b if b == ord(" ") else _BYTES.get(b, b) for b in range(256)], "<u2")

#: Latin-1 words that are one pre-token and in normal form: lower-case letters alone.
_LETTERS = re.compile("[a-zªµºß-öø-ÿ]+").fullmatch


def _plain(text: str) -> str:
    """Lower case, as the vocabulary's normaliser makes it, where both surely agree; otherwise the text itself."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class Words:
    """Ids of white-space words, as bytes; two generations, so that frequent words outlive the rare."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.bits = max(1, (self.size - 1).bit_length())
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parted = self._parts()

    def _parts(self) -> bool:
        """Whether the shortcuts hold for this vocabulary: its normaliser lower-cases Latin-1 and makes white space a space, its
        pre-tokenizer drops that and spells bytes as ``_BYTES`` does, its model is merges, and no token holds a letter and what
        isn't one behind it. Otherwise whole texts go to the library."""
        library, latin = self.library, list(map(chr, range(256)))
        if type(library.model).__name__ != "BPE" or library.normalizer is None or library.pre_tokenizer is None:
            return False
        normal = all(library.normalizer.normalize_str(c) in (c.lower(), " " if c.isspace() else c.lower()) for c in latin)
        words = [p[0] for p in library.pre_tokenizer.pre_tokenize_str("ab cd\nef  é")]
        apart = words[:1] == ["ab"] and all(_SPACES.isdisjoint(w) or _SPACES.issuperset(w) for w in words) and "".join(words[-1:]) == "é".encode().decode("latin-1").translate(_BYTES)
        bytes_ = {v: k for k, v in _BYTES.items()}
        spelt = (bytes(bytes_.get(ord(c), ord(c)) for c in t).decode(errors="replace") for t in library.get_vocab(with_added_tokens=False) if all(ord(c) in bytes_ or ord(c) < 256 for c in t))
        mixed = any(a.isalpha() and b in _MARKS for t in spelt for a, b in zip(t, t[1:]))
        probes = ["The Cat's (pyjamas), 12 o'clock!\n\n É x", "a  b\tc", "x.y,z -- w?!", "\n", " ", "don't stop's we'll"]
        if not (normal and apart and not mixed):
            return False
        self.parted = True
        wanted = [library.encode(p, add_special_tokens=False).ids for p in probes]
        found = [np.frombuffer(ids, self.kind).tolist() for ids in self.encode(probes)]
        self.known = {}
        return wanted == found

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.parted:
            return [array(self.code, found.ids).tobytes() for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        cut = pc.split_pattern(pa.array([_plain(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        parts = _parted(coded.dictionary).dictionary_encode()
        ids, ends = _placed(pa.array(self._known(_listed(parts.dictionary)), pa.large_binary()), parts.indices)
        ids, ends = _placed(_binary(ends[::2], ids), coded.indices)
        ends, ids = ends[cut.offsets.to_numpy()].tolist(), memoryview(ids)
        return [bytes(ids[i:j]) for i, j in zip(ends, ends[1:])]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each of these words, which are kept."""
        if len(self.known) > KEPT:
            self.known, self.old = {}, self.known
        known, found, letters, rest = self.known, list(map(self.known.get, words)), [], []
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, map(self.old.get, [words[i] for i in new])):
            if ids is not None:
                known[words[i]] = found[i] = ids
            else:
                (letters if _LETTERS(words[i]) else rest).append(i)
        merge, code = self.library.model.tokenize, self.code
        for i, spelt in zip(letters, _spelt([words[i] for i in letters])):
            known[words[i]] = found[i] = array(code, [t.id for t in merge(spelt)]).tobytes()
        for i, whole in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            known[words[i]] = found[i] = array(code, whole.ids).tobytes()
        return found


def _listed(words: pa.LargeStringArray) -> list[str]:
    """Words without spaces as a list, much faster than one by one."""
    spaced = pc.binary_join_element_wise(words, *pa.array(["", " "], words.type))
    return str(spaced.buffers()[2] or b"", "utf-8").split(" ")[:-1]


def _spelt(words: list[str]) -> list[str]:
    """Words without spaces, byte by byte in ``_SPELT``."""
    return _SPELT[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le").split(" ")


def _parted(words: pa.LargeStringArray) -> pa.LargeStringArray:
    """Each word in two: before and from the marks at its end, if those follow a letter; otherwise whole, and nothing.

    No token of the vocabulary holds a letter and what isn't one behind it, so a word's end can be encoded by itself.
    """
    core = pc.utf8_rtrim(words, _MARKS)
    size = pc.binary_length(pc.if_else(pc.match_substring_regex(core, "[A-Za-zªµºÀ-ÖØ-öø-ÿ]$"), core, words)).to_numpy()
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    both = np.repeat(ends, 2)[:-1]
    both[1::2] += size
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(both), words.buffers()[2])


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends)), data])


def _placed(ids: pa.LargeBinaryArray, places: pa.Int32Array) -> tuple[pa.Buffer, np.ndarray]:
    """The values at these places, one after another, and where each begins and the last ends."""
    taken = ids.take(places)
    return taken.buffers()[2] or pa.py_buffer(b""), np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)


@lru_cache(1)
def _words(path: str) -> Words:
    return Words(path)


_WRITTEN = "part long, seq long, before long, n_tokens long, n_docs long, shard binary"
_NAMES = ["part", "seq", "before", "n_tokens", "n_docs", "shard"]


def _writer(path: str, end: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq, before = _words(path), TaskContext.get().partitionId(), 0, 0
        last = np.array([end], words.kind).tobytes()
        docs, parts, held = [], [], 0

        def flush():
            nonlocal seq, before, docs, parts, held
            ids = np.frombuffer(b"".join(parts), words.kind)
            ends = np.cumsum([len(p) // words.kind.itemsize for p in parts])
            shard = Shard.build(ids, max(words.bits, end.bit_length()), np.array([d or 0 for d in docs], np.int64), np.array([d is None for d in docs]), ends.astype(np.int64))
            row = [part, seq, before, len(ids), len(docs), shard.dump()]
            seq, before, docs, parts, held = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names=_NAMES)

        for batch in steps(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                docs.append(doc)
                parts.append(ids + last)
                held += len(parts[-1]) // words.kind.itemsize
                if held >= limit:
                    yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, out: str, tokenizer: str, *, end: int = 2, shard: int = SHARD) -> None:
    """Writes the ids of ``docs`` (doc_id long, text) to shards below ``out``, in ascending doc_id order."""
    dealt = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(tokenizer, end, shard), _WRITTEN).write.option("compression", "uncompressed").parquet(out)


def _reader(bases: dict[int, int], arrays: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "shard")), strict=True):
                shard = Shard.load(data)
                ids, ends = shard.tokens(), shard.ends
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                last = (
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(wide, pa.int64())) if arrays
                    else pa.array([zlib.crc32(wide[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.docs, pa.int64(), mask=shard.nulls), pa.array(starts + (bases[part] + before)), pa.array(ends - starts), last],
                    names=["doc_id", "start", "n_tokens", "ids" if arrays else "ids_crc32"],
                )

    return run


def read(spark: SparkSession, out: str, *, arrays: bool = True) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it), n_tokens and its ids, or else their CRC-32.

    The driver holds one total for each written partition, whose number follows the folder's files.
    """
    shards = spark.read.schema(_WRITTEN).parquet(out)
    bases, total = {}, 0
    for row in shards.groupBy("part").sum("n_tokens").orderBy("part").collect():
        bases[row[0]] = total
        total += row[1]
    return shards.select("part", "before", "shard").mapInArrow(_reader(bases, arrays), "doc_id long, start long, n_tokens long, " + ("ids array<long>" if arrays else "ids_crc32 long"))
