import public_tokenizers
import pyarrow as pa
import sentencepiece
from folioscope.llm import decontaminate, pieces as p, quality
from hypothesis import given, settings, strategies as st

from . import brute

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", " a", "a  b", " \n x", "\n", "a \n\n  b ", "▁x ▁▁y", "日本語 テキスト", "😀😀 é", "é ê", "\t\ttab", "a b", "x" * 5000, "ab" * 300 + " " + "9f" * 200,
    "</s> <s> <unk> <0x0A>", "a\x00b", "\r\n x", " " * 500, "\n" * 300, "▁", "“quoted” — dash…", "The same text.", "The same text.",
]


def test_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in p.encode(docs, PATH).collect()}
    short = {r.doc_id: r for r in p.encode(docs, PATH, keep=["doc_id"], digests=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or ""), 2]
        assert not got[i].differs and got[i].ids == ids and got[i].decoded == library.decode(ids) and got[i].text == t
        assert tuple(short[i]) == (i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids)), False)
    assert p.encode(docs.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n▁abeinortTh.,é日\t-'9"), max_size=60))
def test_any_text(text):
    pieces = p._pieces(PATH)
    assert next(iter(pieces.encode([text]))).tolist() == [*pieces.library.encode(text), 2]


def test_heap_and_rounds_agree():
    pieces = p._pieces(PATH)
    units = [[pieces.symbols[c] for c in w] for w in ("▁internationalisation", "▁aaaaaaaaaaaaaa", "▁the", "▁", "▁thththththt")]
    symbols, sizes = pieces.together(p.np.concatenate(units), p.np.array(list(map(len, units))))
    assert [x.tolist() for x in p.np.split(symbols, p.np.cumsum(sizes)[:-1])] == [pieces.alone(u) for u in units]


def test_other_ids_of_the_library_are_reported_and_not_taken(monkeypatch):
    pieces = p.Pieces(PATH)
    monkeypatch.setattr(p, "_pieces", lambda path: pieces)
    (right, text, differs), = p.coded(PATH, ["the same"])
    assert not differs and text == "the same"
    pieces.known = {u: p.np.array([260], p.ID).tobytes() for u in pieces.units("the same")}
    (ids, text, differs), = p.coded(PATH, ["the same"])
    assert differs and ids == [260, 260, 2] and text == pieces.library.decode(ids)


def test_the_library_encodes_each_unit_once(monkeypatch):
    pieces, seen = p.Pieces(PATH), []

    class Library:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, texts, **options):
            seen.extend(texts)
            return library.encode(texts, **options)

    library, pieces.library = pieces.library, Library()
    monkeypatch.setattr(p, "_pieces", lambda path: pieces)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        for text, (ids, decoded, differs) in zip(texts, p.coded(PATH, texts), strict=True):
            assert not differs and ids == [*library.encode(text), 2] and decoded == library.decode(ids)
    assert len(seen) == len(set().union(*map(pieces.units, texts)))  # whole texts, and twice, before
    monkeypatch.setattr(p, "KEPT", 3)
    for text in texts * 2:
        assert [d for _, _, d in p.coded(PATH, [text])] == [False]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n▁abeinortTh.,é日\t-'9"), max_size=60))
def test_no_text_differs(text):
    assert [d for _, _, d in p.coded(PATH, [text])] == [False]


def test_texts_that_the_library_reads_otherwise_differ(monkeypatch):
    pieces = p.Pieces(PATH)
    monkeypatch.setattr(p, "_pieces", lambda path: pieces)

    class Library:
        def __getattr__(self, name):
            return getattr(library, name)

        def normalize(self, texts):
            return [t.replace("A", "a") for t in library.normalize(texts)]

    library, pieces.library = pieces.library, Library()
    assert [d for _, _, d in p.coded(PATH, ["the A", "the a"])] == [True, False]


def test_a_worker_keeps_units_until_a_task_of_another_operator():
    batch = pa.record_batch({"doc_id": [1], "text": ["some words, and more words"]})
    encoded = lambda: list(p._run("text", ["doc_id"], PATH, False)(iter([batch])))
    first, held = encoded(), p._pieces(PATH)
    assert encoded() == first and p._pieces(PATH) is held and "words" in held.known
    for other in (quality._describe("text", ["doc_id"]), lambda batches: decontaminate.steps(batches, "text")):
        assert len(list(other(iter([batch])))) == 1
        assert not p._pieces.cache_info().currsize
        assert encoded() == first and p._pieces.cache_info().currsize
