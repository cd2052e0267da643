import corpus_pipeline
import pytest
from folioscope.llm import decontaminate as d

from . import brute

DOCS = [
    (1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "A, b; C d E f g h I j k-l M n a b c d e f g h i j k l m"), (5, "x y"),
    (6, "x " * 3000 + "É1 éü"), (7, "x y"), (7, "x y"), (8, "... !!"), (9, "d e f g h i j k l m n o p q"), (10, "é1 ÉÜ É1 éü"),
]
ITEMS = [(1, "a b c d e f g h i j k l m"), (2, "É1 éü"), (3, None), (4, "!?"), (None, "x y"), (11, "X y"), (2, "d e f g h i j k l m n o p q")]


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_against_brute_force(spark, block):
    docs = spark.createDataFrame([(*x, "q", 7) for x in DOCS], "doc_id long, text string, hits string, size int")
    items = spark.createDataFrame([(*x, "z") for x in ITEMS], "item_id long, text string, doc_id string")
    got = d.digest(d.scan(docs, items, block_bytes=block), ["doc_id"]).collect()
    assert sorted(map(tuple, got)) == sorted(brute.decontaminate(DOCS, ITEMS))


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(*x, "q") for x in DOCS], "doc_id long, text string, extra string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {x[0] for x in brute.decontaminate(DOCS, ITEMS) if x[-1]}
    assert {r.doc_id for r in d.remove(docs, items).collect()} == {x[0] for x in DOCS} - bad
    cut = {r.doc_id: r.text for r in d.remove_spans(docs, items).collect()}
    assert cut[5] == "" and cut[8] == "... !!" and cut[1] == " n" and cut[10] == "é1 " "ÉÜ "
    clash = d.remove_spans(docs.withColumnRenamed("extra", "hits"), items, block_bytes=1)
    assert clash.columns == ["doc_id", "text", "hits"] and {r.doc_id: r.text for r in clash.collect()} == cut and {r.hits for r in clash.collect()} == {"q"}
    assert d.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert d.scan(docs.limit(0), items).count() == 0


def test_the_pipeline_leaves_no_window(spark):
    """A whole window takes its document with it, however long that is; a shorter item alone is cut out."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    window = " ".join(x.decode() for x in d.words(items.orderBy("item_id").first().text.encode())[:13])
    long = "w " * 2000
    docs = spark.createDataFrame([(1, f"{long}{window} {long}", 1), (2, window, 2), (3, long, 3), (4, f"{long}{window.rsplit(' ', 1)[0]} {long}", 4)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.unseen(spark, docs, "/root/testdata/sf0.001").collect()}
    assert set(got) == {3, 4} and got[3] == (long, len(long)) and got[4][0] == docs.where("doc_id = 4").first().text
    left = spark.createDataFrame([(k, *v) for k, v in got.items()], "doc_id long, text string, n_chars long")
    assert d.scan(left, items).where("n_hit > 0").count() == 0
    short = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert [r.text for r in d.clean(spark.createDataFrame([(1, f"{long}X, y; z! {long}"), (2, "x y z")], "doc_id long, text string"), short).collect()] == [f"{long}! {long}"]


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(d.Windows, "_hash", lambda self, ids, places, size: ids[places].astype(d.np.uint64) % d.np.uint64(3))
    block = d.Block()
    for item, text in ITEMS:
        if item is not None:
            block.add(str(item), (text or "").encode())
    windows, want = d.Windows(block, 13), {x[0]: x for x in brute.decontaminate(DOCS, ITEMS[:4] + ITEMS[5:])}
    for doc, text in DOCS:
        ids = d.np.array([windows.vocabulary.get(w, 0) for w in d.words((text or "").encode())] + [0], d.np.int32)
        hit = {p for size, at, _, _ in windows.find(ids) for i in at.tolist() for p in range(i, i + size)}
        assert len(hit) == want[doc][2]
