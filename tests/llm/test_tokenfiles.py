import zlib

import numpy as np
import pytest
import public_tokenizers
from folioscope.llm import tokenfiles as t
from folioscope.llm.common import work_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cat's pyjamas, aren't they?", None, "", " ", "a  b\n\nc\tD", "É É écran ÀÉ 123 4", "日本語 テキスト", "x" * 3000, "word " * 5000, "😀 — “q”", "Same", "Same", "<|endoftext|> x",
    "a b c", " ́combining é", "ΑΣ ΣΑΣ İI",
]


def test_files_hold_what_the_library_encodes(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 17 if i else None, x, "clash") for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    out = work_path(spark, "test-tokenfiles")
    t.write(docs, out, PATH, shard=400)
    got = sorted(map(tuple, t.read(spark, out).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), ids))
        start += len(ids)
    assert got == want
    short = sorted(map(tuple, t.read(spark, out, arrays=False).collect()), key=lambda r: r[1])
    assert short == [(*w[:3], zlib.crc32(np.array(w[3], "<u4").tobytes())) for w in want]
    none = work_path(spark, "test-tokenfiles")
    t.write(docs.limit(0), none, PATH)
    assert t.read(spark, none).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_shortcuts_are_taken_only_where_they_hold(name):
    path = public_tokenizers.path(name)
    words, library = t.Words(path), Tokenizer.from_file(path)
    assert words.parted == (name == "word_bpe_49k.json")
    texts = [x or "" for x in TEXTS]
    assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 2), (511, 7), (512, 50000), (5000, 300)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    none = np.zeros(0, np.int64)
    shard = t.Shard.load(t.Shard.build(ids, 16, none, none.astype(bool), none).dump())
    assert (shard.tokens() == ids).all()
    for i in range(0, n, 37):
        token, places = int(ids[i]), np.flatnonzero(ids == ids[i])
        assert shard.access(i) == token and shard.count(token, i // 2, n) == (places >= i // 2).sum()
        assert [shard.occurrence(token, j) for j in range(min(5, len(places)))] == places[:5].tolist()
    with pytest.raises(IndexError):
        shard.occurrence(1, n)


def test_a_step_meets_each_distinct_word_once():
    class Asked(dict):
        def __init__(self):
            self.words = []

        def get(self, word, other=None):
            self.words.append(word)
            return super().get(word, other)

        def __getitem__(self, word):
            self.words.append(word)
            return super().__getitem__(word)

    class Library:
        def __init__(self, library):
            self.library, self.model, self.whole = library, library.model, []

        def encode_batch_fast(self, words, **how):
            self.whole += words
            return self.library.encode_batch_fast(words, **how)

    words, library = t.Words(PATH), Tokenizer.from_file(PATH)
    words.known, words.library = Asked(), Library(words.library)
    texts = ["écran, word " * 500, "Écran; écran\nother! 12"]
    assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert sorted(words.known.words) == ["", "!", ",", "12", ";", "other", "word", "écran"]
    assert sorted(words.library.whole) == ["", "!", ",", "12", ";"]


def test_random_texts_are_encoded_as_by_the_library():
    random = np.random.default_rng(9)
    latin = [chr(c) for c in range(256)]
    pieces = ["the", "Cat", "'s", "'LL", "écran", "É", "ß", " ", " ", " ", "\n", "...", "!?", "12", "<|endoftext|>", "<|", "|>", *latin]
    wide = [*pieces, "日本", "ΑΣ", "İ", "é", "̸", "≠", " ", "　", "😀", "ﬁ"]
    texts = ["".join(random.choice(p, random.integers(0, 40))) for p in (pieces, wide, pieces[:14]) for _ in range(300)]
    words, library = t.Words(PATH), Tokenizer.from_file(PATH)
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):  # the second time from the words that are kept
        assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts)] == want


@pytest.mark.parametrize(("n", "bits", "kind"), [(1 << 14, 16, np.uint16), (50000, 17, np.uint32)])
def test_long_shards_are_unfolded_whole(n, bits, kind):
    none = np.zeros(0, np.int64)
    ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype(kind)
    shard = t.Shard.load(t.Shard.build(ids, bits, none, none.astype(bool), none).dump())
    assert (shard.tokens() == ids).all() and shard.access(n - 1) == ids[-1]
