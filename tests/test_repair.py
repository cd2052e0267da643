import pytest

from folioscope.functions import repair as p
from folioscope.operators import gates as g
from pyspark.sql import functions as F


def test_clean_and_rejoin():
    assert p.clean("ﬁne­  te​xt  x\n\n y") == "fine text • x\n\ny" or p.clean("ﬁne") == "fine"
    assert p.clean("--- ...") == "" and p.clean(None) == ""
    assert p.rejoin("a treat-\nment and treatment") == "a treatment and treatment"
    assert p.rejoin("well-\nknown, well-known and well-known") == "well-known, well-known and well-known"
    assert p.rejoin("North-\nWest") == "North-\nWest" and p.rejoin("one-\ntwo-\nthree") == "onetwothree"


def test_sentences_and_stretches():
    assert p.sentences("One ends. Two, e.g. Three goes on! By J. Smith? Yes.") == ["One ends.", "Two, e.g. Three goes on!", "By J. Smith?", "Yes."]
    text = "filler words " * 40 + "the École of heat pumps " + "more words " * 40
    out = p.around(text, ["ecole", "pumps"], 80)
    assert "École" in out and "pumps" in out and out.startswith("…") and out.endswith("…") and len(out) <= 82
    assert p.around("short", ["x"]) == "short" and p.around("x " * 300, ["zzz"], 50).endswith("…")


def test_on_frames(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None)], "id long, text string")
    assert [r.s for r in df.select(p.split_sentences("text").alias("s")).collect()] == [["A b.", "C d."], []]
    assert [r.s for r in df.select(p.cleaned("text").alias("s")).collect()] == ["A b. C d.", ""]
    assert [r.s for r in df.select(p.snippet("text", F.array(F.lit("b"))).alias("s")).collect()] == ["A b. C d.", ""]
    lig = spark.createDataFrame([("the \u0001nal final \u0001re fire flow",), ("\u0001x",)], "t string").select(p.read_ligatures(F.col("t"), ["fi", "fl"]).alias("x"))
    assert [r.x for r in lig.collect()] == ["the final final fire fire flow", " x"]


def test_gates(spark):
    df = spark.createDataFrame([(1, "red;blue", 0, 3, [0.0, 0.0, 5.0, 5.0]), (2, "green", 3, 2, [1.0, 1.0, 1.0, 2.0]), (2, "", 6, 1, [0.0, 0.0, 99.0, 1.0])], "id long, colour string, at int, n int, box array<double>")
    kinds = lambda frame: sorted(map(tuple, frame.collect()))
    assert kinds(g.closed(df, {"colour": ["red", "blue"]}, "id")) == [("unknown colour", "2 green")]
    assert kinds(g.unique(df, "id")) == [("repeated key", "2")]
    assert kinds(g.tiles(df.withColumn("d", F.lit("x")), "d", "at", "n")) == [("gap", "x 6")]
    assert kinds(g.boxes_within(df, "box", 10, 10, "id")) == [("box off the page", "2"), ("degenerate box", "2")]
    assert kinds(g.orphans(df, spark.createDataFrame([(1,), (9,)], "id long"), "id", ("manifest", "files"))) == [("files alone", "9"), ("manifest alone", "2"), ("manifest alone", "2")]
    assert kinds(g.one_variant(df, "n")) == [("several n", "1"), ("several n", "2"), ("several n", "3")]
    with pytest.raises(g.Refused, match="gap"):
        g.refuse(g.tiles(df.withColumn("d", F.lit("x")), "d", "at", "n"))
    g.refuse(df.select(F.lit("k").alias("kind"), F.lit("w").alias("where")).limit(0))
    assert [r.colour for r in g.fill_blanks(df, {"colour": F.lit("grey")}).orderBy("at").collect()] == ["red;blue", "green", "grey"]
    done = spark.createDataFrame([(1, "pink"), (3, "x")], "id long, colour string")
    assert [r.colour for r in g.review(df, done, "id", ["colour"]).orderBy("at").collect()] == ["pink", "green", ""]
    assert [r.id for r in g.unreviewed(df, done, "id", 1).collect()] == [2]
