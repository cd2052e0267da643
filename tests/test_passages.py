import random
from types import SimpleNamespace

from folioscope.operators import passages as p
from folioscope.plans import texts

ITEM = "a passage of a benchmark that is longer than forty characters"
DOCS = [
    (1, f"«{ITEM}»"), (2, f"({ITEM}) and ({ITEM})"), (3, f"x—{ITEM}"), (4, f"x {ITEM}"), (5, "漢字" + "これは四十文字より長い問題文であり空白を含まない" * 3), (6, ITEM[:-1]),
    (7, f"y {ITEM}"), (7, ITEM), (8, None), (9, ""), (10, "short one"), (None, ITEM), (11, ITEM[:30]), (12, ITEM[30:] + "short"),
]
ITEMS = [(1, ITEM), (2, "これは四十文字より長い問題文であり空白を含まない" * 2), (3, "short"), (4, "hort one"), (5, "é"), (6, None), (7, ""), (1, ITEM), (8, ITEM[5:25])]


def brute(docs, items):
    return sorted(((k, d) for d, t in docs for k, i in items if t and i and i in t), key=repr)


def test_hits_at_any_place_and_of_any_length(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    assert {d for k, d in want if k == 1} == {1, 2, 3, 4, 7, None}
    for n in (None, 0):
        x = SimpleNamespace(documents=docs if n is None else docs.limit(0), benchmark=items)
        assert sorted(map(tuple, texts.hit_documents(x).collect()), key=repr) == (want if n is None else [])
    assert texts.hit_documents(SimpleNamespace(documents=docs, benchmark=items.limit(0))).count() == 0


def test_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        rows = ["".join(rng.choices("ab", k=rng.randrange(90))).encode() for _ in range(8)]
        items = [(k, "".join(rng.choices("ab", k=rng.randrange(1, 12))).encode()) for k in range(20)] + [(k, rows[k % 8][k % 7 : k % 7 + 40]) for k in range(20, 30)]
        items = [(k, t) for k, t in items if t]
        assert sorted(p.Passages(items).find(rows)) == sorted((row, k) for row, text in enumerate(rows) for k, t in items if t in text)
