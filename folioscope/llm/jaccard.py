"""Jaccard join over word n-grams with adaptive multi-match prefixes, and the classes its links form.

A document's set is that of its distinct ``n``-word shingles, as 64-bit hashes; two documents link when
``100 * |intersection| >= percent * |union|``. All sets are ordered by one global order: by the number of documents that
have a shingle, in eighths of a power of two, then by hash. A set of size s shares at least ``o = ceil(percent * s / 100)``
elements with each partner, so for any l two linked documents share at least l elements within their first
``s - o + l``. l is chosen by document: the one with the least estimated cost of scanning its prefix's lists and of
verifying the candidates that share l elements.

1. Texts are packed into chunks. Each chunk sends its distinct shingles, cut to as many bits as the corpus needs, to their
buckets, which answer with those that two documents or more have, and how many; the others match nothing and come
first in the order. 2. Each document gives its size, its set's digest, its shared shingles in order, and those within
its prefix for l = 1; documents with equal sets become one class. 3. Classes that share a prefix element are tied to the
element's smallest class, and the ties' components are the candidate groups: linked documents are always in one group.
Only a document most of whose shingles are shared has shared ones in its prefix. 4. A group is a unit; a large one is cut
into blocks, each a unit with ``PIVOTS`` classes of the group, by which near copies of one text come together. A unit counts
matches over the adaptive prefixes, verifies candidates that aren't connected yet on their whole sets, and gives a spanning
forest of its links. What the units of a large group leave apart is compared block with block, but never within one component.
5. The components of the forests and of the copies' ties to their class are the result. No pair within a group is emitted but
forest edges.

Defined results: a null or empty text and one of white space alone has size 0, links with nothing and is its own
component; a null id has a null component; rows with equal ids are one document, each text of which may link; extra
columns take no part; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .chunks import Chunk, bucket_of, deltas, pack, rows_of, spread, squeeze
from .common import cut, steps, texts
from .components import components

SHINGLE, PERCENT = 5, 80
#: Bits of a hash beyond those that number the corpus's shingles: a shingle is taken for shared by mistake once in 2**13.
SPARE = 13
#: A unit's blocks: most classes and shingles of one, before a group is cut into more.
BLOCK, BLOCK_SHINGLES = 768, 400_000
#: Classes of a large group that all its blocks meet: of each of so many hash values the one of smallest id.
PIVOTS = 32
#: Parts that a large group's rows are dealt in before it has blocks.
SALTS = 64
#: Words whose hashes a task keeps.
KEPT = 200_000
#: Cost of one verification in list entries scanned.
VERIFY = 48.0

_U = np.uint64
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(values: list[bytes], n: int, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words has its whole sequence as one.

    ``known`` keeps words' hashes for a task.
    """
    if len(known) > KEPT:
        known.clear()
    for value in values:
        words = value.translate(_LOW).split()
        if not words:
            yield np.zeros(0, np.uint64)
            continue
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(n, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out * _BASE + h[k : len(h) - size + 1 + k])
        yield np.unique(out)


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with any it links to."""
    return -(-percent * size // 100)


def _sets(chunk: Chunk, n: int, known: dict[bytes, int]) -> list[np.ndarray]:
    return list(shingles([chunk.text(i) for i in range(len(chunk.ids))], n, known))


def _ask(n: int, bits: int, buckets: int):
    """A chunk's distinct shingles by bucket, cut to ``bits`` bits, with the number of its documents that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for chunk, data in rows_of(batches, "chunk", "data"):
            every = np.concatenate([np.zeros(0, _U), *_sets(Chunk.load(data), n, known)]) >> _U(64 - bits)
            found, times = np.unique(every, return_counts=True)
            bounds = np.searchsorted(bucket_of(found << _U(64 - bits), buckets), np.arange(buckets + 1)).tolist()
            rows = [(b, squeeze(deltas(found[i:j]), np.minimum(times[i:j], 65535).astype(np.uint16))) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "chunk", "asked"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk its shingles that two documents or more have, and eight times log2 of their number."""
    chunks = table.column("chunk").to_pylist()
    parts = [spread(v) for v in table.column("asked").to_pylist()]
    own = [np.cumsum(p[0], dtype=_U) for p in parts]
    _, which = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([p[1] for p in parts]))
    kind = np.where(total > 1, np.minimum(255, np.rint(np.log2(total) * 8)), 0).astype(np.uint8)[which]
    at, rows = 0, []
    for chunk, mine in zip(chunks, own, strict=True):
        kinds = kind[at : at + len(mine)]
        at += len(mine)
        if kinds.any():
            rows.append((chunk, squeeze(deltas(mine[kinds > 0]), kinds[kinds > 0])))
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "shared": pa.array([r[1] for r in rows], pa.binary())})


def _describe(n: int, percent: int, bits: int):
    """Each document's size, digest, shared shingles in order (if its prefix has any), their kinds, and the prefix's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        for data, answers in rows_of(batches, "data", "answers"):
            chunk = Chunk.load(data)
            sets, parts = _sets(chunk, n, words), [spread(a) for a in answers or ()]
            known, kinds = np.concatenate([np.zeros(0, _U), *(np.cumsum(p[0], dtype=_U) for p in parts)]), np.concatenate([np.zeros(0, np.uint8), *(p[1] for p in parts)])
            order = np.argsort(known)
            known, kinds = np.append(known[order], ~_U(0)), np.append(kinds[order], 0)
            rows = []
            for doc, s in zip(chunk.ids.tolist(), sets, strict=True):
                cut_ = s >> _U(64 - bits)
                at = np.searchsorted(known, cut_)
                kind = np.where(known[at] == cut_, kinds[at], 0)
                shared = s[kind > 0]
                by = np.lexsort((shared, kind[kind > 0]))
                prefix = len(s) - needed(len(s), percent) + 1 - (len(s) - len(shared)) if len(s) else 0
                digest = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((doc, len(s), digest, shared[by].tobytes(), shared[by][:prefix].view(np.int64)) if prefix > 0 else (doc, len(s), digest, None, []))
            if rows:
                kinds_ = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True)], names=["doc_id", "n_shingles", "digest", "shared", "prefix"])

    return run


def depth(freq: np.ndarray, size: int, least: int) -> int:
    """The l of least estimated cost for a set whose ordered elements' other occurrences number ``freq``.

    Scanning the prefix costs the lengths of its elements' lists; at most a l-th of what is scanned can be a candidate.
    """
    first = size - least
    scanned = np.cumsum(freq)[first : first + least]
    matches = np.arange(1, len(scanned) + 1)
    return int(np.argmin(scanned * (1 + VERIFY / matches))) + 1


def _forest(size: int):
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, root


def linked(ids: list[int], sizes: np.ndarray, lists: list[np.ndarray], sides: np.ndarray | None, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of ``sizes`` with their shared elements in order; with ``sides``, among
    pairs of different sides alone. Sets with one number in ``known`` are connected already."""
    m = len(lists)
    held = np.array([len(s) for s in lists])
    sets = [np.sort(s) for s in lists]
    flat, owner = np.concatenate(lists), np.repeat(np.arange(m), held)
    _, element, freq = np.unique(flat, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(held)])
    place = np.arange(len(flat)) - starts[owner] + (sizes - held)[owner]  # elements that match nothing come first
    least = np.array([needed(int(s), percent) for s in sizes])
    depths = np.array([depth(np.concatenate([np.zeros(sizes[i] - held[i]), freq[element[starts[i] : starts[i + 1]]] - 1.0]), int(sizes[i]), int(least[i])) for i in range(m)])
    level = np.maximum(1, place - (sizes - least)[owner] + 1)  # the l from which an element is in its set's prefix
    inside = np.flatnonzero((level <= depths[owner]) & (freq[element] > 1))
    by = inside[np.argsort(element[inside], kind="stable")]
    bounds = np.searchsorted(element[by], np.arange(len(freq) + 1))
    parent, root = _forest(m)
    if known is not None:
        parent[:] = np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]].tolist()
    out = []
    for x in range(m):
        mine = inside[np.searchsorted(inside, starts[x]) : np.searchsorted(inside, starts[x + 1])]
        if not len(mine):
            continue
        found = np.concatenate([by[bounds[e] : bounds[e + 1]] for e in element[mine].tolist()])
        l = depths[x]
        hits = np.bincount(owner[found[level[found] <= l]], minlength=m)
        # The side with the smaller l tests a pair; l matches within both prefixes for that l are needed.
        fits = (hits >= l) & ((depths > l) | (depths == l) & (np.arange(m) > x))
        fits &= 100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])
        if sides is not None:
            fits &= sides != sides[x]
        if known is not None:
            fits &= known != known[x]
        for y in np.flatnonzero(fits).tolist():
            a, b = root(x), root(y)
            if a == b:
                continue
            both = _overlap(sets[x], sets[y])
            if 100 * both >= percent * (int(sizes[x]) + int(sizes[y]) - both):
                parent[max(a, b)] = min(a, b)
                out.append((ids[x], ids[y]))
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _unit(percent: int):
    """The links within a block and with its group's pivots."""

    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("doc_id").to_numpy(), return_index=True)  # a pivot may be of the block itself
        table = table.take(pa.array(first))
        lists = [np.frombuffer(b, _U) for b in table.column("shared").to_pylist()]
        return _edges(linked(ids.tolist(), table.column("n_shingles").to_numpy(), lists, None, percent))

    return run


def _across(percent: int):
    """The links between two blocks, or within one of small components, that connect what isn't connected yet."""

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b, _U) for b in table.column("shared").to_pylist()]
        whole = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sides = None if whole else table.column("bid").to_numpy()
        return _edges(linked(table.column("doc_id").to_pylist(), table.column("n_shingles").to_numpy(), lists, sides, percent, table.column("comp").to_numpy()))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([e[0] for e in found], pa.int64()), "v": pa.array([e[1] for e in found], pa.int64())})


def _parts(count, shingles_):
    """Blocks that so many classes with so many shingles are cut into."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _residual(large: DataFrame, first: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The links of large groups between classes that the ``first`` links don't connect.

    A component beyond a block's size is cut into blocks of its own; smaller ones are packed. Pairs of blocks of one component
    are never compared, so a group that the first links connect costs nothing more.
    """
    comps = components(first.join(large.select(F.col("doc_id").alias("u")), "u", "left_semi")).withColumnRenamed("node", "doc_id").withColumnRenamed("root", "comp")
    placed = large.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    sizes = cut(placed.groupBy("root", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")), "jaccard-components")
    open_ = sizes.groupBy("root").agg(F.count("*").alias("k"), _parts(F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))), F.sum(F.when(F.col("n") <= BLOCK, F.col("s")))).alias("packs")).where("k > 1").drop("k")
    own = sizes.join(open_, "root").select("root", "comp", "packs", (F.col("n") > BLOCK).alias("big"), _parts(F.col("n"), F.col("s")).alias("parts"))
    dealt = placed.select("doc_id", "digest", "root", "comp").join(own, ["root", "comp"])
    place = F.when(F.col("big"), F.xxhash64("comp", F.pmod(F.xxhash64("doc_id"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("comp"), F.col("packs")))
    dealt = cut(dealt.select("doc_id", "digest", "root", "comp", "big", place.alias("bid")), "jaccard-dealt")
    blocks = dealt.groupBy("root", "bid").agg(F.max(F.when(F.col("big"), F.col("comp"))).alias("of"))
    a, b = blocks.select("root", F.col("bid").alias("i"), F.col("of").alias("x")), blocks.select("root", F.col("bid").alias("j"), F.col("of").alias("y"))
    pairs = a.join(b, "root").where("(i < j AND NOT coalesce(x = y, false)) OR (i = j AND x IS NULL)").select("root", "i", "j")
    each = pairs.select("root", F.explode(F.array_distinct(F.array("i", "j"))).alias("bid"), "i", "j")
    held = dealt.join(each, ["root", "bid"]).join(classes.where("shared is not null").select("digest", "n_shingles", "shared"), "digest")
    return held.select("root", "i", "j", "bid", "comp", "doc_id", "n_shingles", "shared").groupBy("root", "i", "j").applyInArrow(_across(percent), "u long, v long")


def join(docs: DataFrame, *, text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable over links) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = pack(rows, "jaccard-chunks").select("chunk", "data")
    many = chunks.count()
    bits, buckets = min(64, ceil(log2(max(2, many))) + 20 + SPARE), max(32, many)
    asked = chunks.mapInArrow(_ask(n, bits, buckets), "bucket long, chunk long, asked binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, shared binary").groupBy("chunk").agg(F.collect_list("shared").alias("answers"))
    kinds = "doc_id long, n_shingles long, digest binary, shared binary, prefix array<long>"
    described = cut(chunks.join(answers, "chunk", "left").select("data", "answers").mapInArrow(_describe(n, percent, bits), kinds), "jaccard")
    sets = described.where("n_shingles > 0")
    classes = cut(sets.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix")), "jaccard-classes")
    elements = classes.select("doc_id", F.explode("prefix").alias("element"))
    shown = elements.groupBy("element").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("element", "least")
    ties = elements.join(shown, "element").where("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    groups = components(ties)
    members = classes.select("doc_id", "digest", "n_shingles").join(groups.withColumnRenamed("node", "doc_id"), "doc_id")
    # Only large groups have rows to join, once for each salt, so that the rows of one don't meet in a task.
    many_blocks = members.groupBy("root").agg(_parts(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("blocks > 1")
    salted = many_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salts = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(SALTS)).cast("int"))
    dealt = salts.join(salted, ["root", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    large = dealt.where("blocks > 1")
    pivots = large.groupBy("root", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PIVOTS))).agg(F.min(F.struct("doc_id", "digest", "blocks")).alias("p")).select("root", "p.digest", "p.blocks")
    units = dealt.select("digest", "root", "block").unionByName(pivots.select("digest", "root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    held = units.join(classes.where("shared is not null").select("digest", "doc_id", "n_shingles", "shared"), "digest")
    links = cut(held.groupBy("root", "block").applyInArrow(_unit(percent), "u long, v long"), "jaccard-links")
    large = cut(large.select("doc_id", "digest", "root", "n_shingles"), "jaccard-large")
    if not large.isEmpty():
        links = links.union(_residual(large, links, classes, percent))
    copies = described.select("doc_id", "digest").join(classes.select("digest", F.col("doc_id").alias("least")), "digest").where("doc_id <> least")
    roots = components(links.union(copies.select("doc_id", "least"))).withColumnRenamed("node", "doc_id")
    out = described.select("doc_id", "n_shingles").join(roots, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    none = rows.where("doc_id is null").mapInArrow(_sizes(n), "n_shingles long")
    return out.unionByName(none.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingles(texts(batch.column("text")), n, {})], pa.int64())], names=["n_shingles"])

    return run


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs``, one row of each group of documents that links connect: that of the smallest doc_id.

    Rows with equal ids are one document, of which the row with the smallest text stays. Rows with null ids all stay.
    """
    stay = join(docs, **options).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_copies"))
    text = options.get("text", "text")
    stay = cut(stay, "jaccard-first")
    # The ids grow with the corpus, so they are never broadcast, however few there are in a small one.
    kept = docs.join(stay.where("_copies = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if stay.where("_copies > 1").isEmpty():
        return kept
    again = docs.join(stay.where("_copies > 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", text)]
    least = again.groupBy("doc_id").agg(F.min(F.struct(text, *others)).alias("_row")).select("doc_id", "_row.*")
    return kept.unionByName(least.select(docs.columns))
