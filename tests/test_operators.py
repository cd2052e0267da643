import random

import numpy as np
import pytest

from folioscope.functions import text as t, vectors as v
from folioscope.operators import chunking, filters, question, ranking as r
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_every_line_is_in_one_passage():
    rng = random.Random(1)
    for _ in range(200):
        rows = [(i, i // 5, "w " * rng.randrange(1, 40), rng.choice([0, 0, 1, 2, 3])) for i in range(rng.randrange(1, 40))]
        for overlap in (0, 12):
            parts = chunking.pack(rows, 60, overlap)
            assert [i for _, a, b in parts for i in range(a, b)] == list(range(len(rows)))
            assert all(c <= a < b for c, a, b in parts)
            assert all(sum(chunking.tokens(x[2]) for x in rows[a:b]) <= 60 or b - a == 1 for _, a, b in parts)


def test_questions():
    assert question.parse("heat | cold -(in (winter)) pumps") == (["heat", "cold", "pumps"], ["in winter"])
    assert question.parse("open +(never closed") == (["open", "never closed"], [])
    for text, why in (("", "empty"), ("x" * 600, "long"), (" | ".join("abcdef" for _ in range(12)), "terms"), ("abc", "short")):
        with pytest.raises(question.Refused, match=why):
            question.check(*question.parse(text))
    with pytest.raises(question.Refused, match="cancelled"):
        question.combine(np.eye(3)[:1], np.eye(3)[:1])


def test_requests_and_weights(spark):
    assert not filters.is_active("") and not filters.is_active({"from": None}) and filters.is_active(["x"])
    for bad in ({"nowhere": "x"}, {"a": ["x"] * 65}, {"a": "x" * 300}, {"a": {"from": "soon"}}):
        with pytest.raises(filters.BadRequest):
            filters.predicate(bad, {"a": F.lit(None)}) if "nowhere" not in bad else filters.validate(bad, {"a"})
    with pytest.raises(ValueError):
        r.weights(0.6, 0.5)


def test_text(spark):
    assert one(spark, t.fold(F.lit("ÉCOLE Ça"))) == "ecole ca" and one(spark, t.tokens(F.lit("A b2 école!"))) == ["b2", "ecole"]
    assert [one(spark, t.ends_sentence(F.lit(x))) for x in ("Done.", "see fig.", "by J.", "item 3.", "Why?", "no")] == [True, False, False, False, True, False]
    assert one(spark, t.isbn_valid(F.lit("0-306-40615-2"))) and one(spark, t.isbn_valid(F.lit("978-0-306-40615-7"))) and not one(spark, t.isbn_valid(F.lit("0306406153")))
    assert one(spark, t.doi_of(F.array(F.lit("DOI: 10.1000/Ab.")))) == "10.1000/ab"
    assert one(spark, t.href(F.lit("a b+c"))) == "a%20b%2Bc"


def test_rounding_rules(spark):
    vec = F.array(*(F.lit(x) for x in (0.5 / 127, 1.5 / 127, -0.5 / 127, 2.0)))
    assert one(spark, v.quantise(vec)) == [0, 2, 0, 127] and one(spark, v.quantise_query(vec)) == [1, 2, 0, 127]
    assert one(spark, v.pack(F.array(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(2.0)))) == 0b1001


def fold_by_loop(rows, per, shown):
    out, winners, counts, more, others = [], {}, {}, {}, {}
    for doc, family, collapsible in rows:
        if len(out) >= shown:
            break
        if collapsible and family:
            if winners.setdefault(family, doc) != doc:
                others.setdefault(family, set()).add(doc)
                continue
        counts[doc] = counts.get(doc, 0) + 1
        if counts[doc] <= per:
            out.append(doc)
        else:
            more[doc] = more.get(doc, 0) + 1
    return out, more, others


def test_fold_is_the_loop(spark):
    rng = random.Random(3)
    for _ in range(4):
        kinds = {d: (rng.choice(["", "f1", "f2", "f3"]), rng.random() < 0.6) for d in range(12)}
        rows = [(d, *kinds[d]) for d in (rng.randrange(12) for _ in range(60))]
        frame = spark.createDataFrame([(i + 1, *x) for i, x in enumerate(rows)], "rank int, doc_id long, family string, collapsible boolean")
        got = sorted(r.fold(frame, shown=15).collect(), key=lambda x: x.place)
        out, more, others = fold_by_loop(rows, 3, 15)
        assert [x.doc_id for x in got] == out
        assert {x.doc_id: x.more for x in got if x.more} == more
        assert {x.family: set(x.alternates) for x in got if x.alternates} == others


def test_batches_stay_within_the_budget(spark):
    """Against the greedy plan made row by row."""
    from folioscope.operators import curation as c

    def price(width):
        return 0.06 * width + 96 * width * width / 1048576

    def plan(lengths, budget, plateau):
        out = []
        for n in lengths:
            wide = max(out[-1][1], n, 1) if out else 0
            if out and out[-1][0] < plateau and (out[-1][0] + 1) * price(wide) <= budget:
                out[-1] = (out[-1][0] + 1, wide)
            else:
                out.append((1, max(n, 1)))
        return [n for n, _ in out]

    cases = [[], [5], [500, 400, 30, 30, 30, 29, 2, 1, 0], [9] * 40, [1, 300, 1, 1, 250, 2] * 5, [100000, 1, 1]]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, lengths array<int>")
    for budget, plateau in ((6.0, 8), (40.0, 64), (0.01, 64)):
        got = df.select("k", c.plan_batches(F.col("lengths"), budget, plateau).alias("calls")).collect()
        assert {r.k: list(r.calls) for r in got} == {k: plan(x, budget, plateau) for k, x in enumerate(cases)}


def test_schemes_by_name(spark):
    from folioscope.functions import vectors as v

    one = spark.createDataFrame([([0.6, -0.8],)], "e array<double>")
    got = one.select(*(v.stored(F.col("e"), s).alias(s) for s in ("fp32", "int8", "binary"))).first()
    assert list(got.fp32) == [0.6, -0.8] and list(got.int8) == [76, -102] and got.binary[0] == -got.binary[1] > 0
    with pytest.raises(ValueError):
        v.stored(F.col("e"), "int3")
