import json

import pytest

from folioscope.sources import readers, writers
from pyspark.sql import functions as F


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tables_in_text(spark, tmp_path):
    p = write(tmp_path / "a.tsv", 'file\ttitle\tyear\na.pdf\t"two\nlines"\t2001\nb.pdf\tshort\n')
    assert [tuple(r) for r in readers.tsv(spark, p, ["file", "title", "year"]).orderBy("file").collect()] == [("a.pdf", "two\nlines", "2001"), ("b.pdf", "short", "")]
    p = write(tmp_path / "q.tsv", "# note\n\nset\tquery\none\tx y\n# more\ntwo\tz\n")
    assert sorted(map(tuple, readers.commented_tsv(spark, p).collect())) == [("one", "x y"), ("two", "z")]
    p = write(tmp_path / "r.tsv", "set\tquery\none\n")
    with pytest.raises(Exception, match="another number of cells"):
        readers.commented_tsv(spark, p).collect()


def test_logs_and_dumps(spark, tmp_path):
    p = write(tmp_path / "v.jsonl", '{"q":"a","d":"b","n":1,"s":0.5}\nnot json\n{"q":"a","d":"b","n":1,"s":0.75}\n{"q":"a","d":"c","n":1,"s":0}\n')
    good, bad = readers.verdicts(spark, p)
    assert sorted(map(tuple, good.collect())) == [("a", "b", 1, 0.75), ("a", "c", 1, 0.0)] and [r.n for r in bad.collect()] == [2]
    dump = {"strategy": "s", "topk": 2, "queries": [{"query_id": "1", "query": "x", "candidates": [{"rank": 1, "score": 0.5}, {"rank": 2, "score": 0.25}]}, {"query_id": "2", "candidates": []}]}
    rows = readers.candidates(spark, write(tmp_path / "c.json", json.dumps(dump))).select("query_id", "rank").collect()
    assert sorted(map(tuple, rows), key=str) == [("1", 1), ("1", 2), ("2", None)]


def test_notes_and_names(spark, tmp_path):
    p = write(tmp_path / "n.md", "# Notes\n## 1.10.0\n### Added\n- one\n- two\n## 1.9.0\n### Fixed\n- three\n")
    notes = readers.release_notes(spark, p)
    assert [(r.version, r.category, r.bullet) for r in notes.orderBy(readers.version_key(F.col("version")), "n").collect()] == [("1.9.0", "Fixed", "three"), ("1.10.0", "Added", "one"), ("1.10.0", "Added", "two")]
    assert [r.file for r in readers.names(spark, write(tmp_path / "l.txt", " a \n\na\n")).collect()] == ["a"]
    with pytest.raises(ValueError, match="tiers"):
        readers.config(write(tmp_path / "c.toml", "[site]\nname='x'\n"), "site", "tiers")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "open"), (2, "b", "restricted")], "doc_id long, text string, access string")
    assert writers.versioned(df, f"{tmp_path}/t") == writers.versioned(df.orderBy(F.desc("doc_id")), f"{tmp_path}/t")
    writers.append(df, f"{tmp_path}/log", ["doc_id"])
    writers.append(df.union(spark.createDataFrame([(3, "c", "open")], df.schema)), f"{tmp_path}/log", ["doc_id"])
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3
    assert [r.doc_id for r in writers.changed(df.withColumn("text", F.when(F.col("doc_id") == 2, "x").otherwise(F.col("text"))), df, "doc_id", "text").collect()] == [2]
    writers.public_half(df, f"{tmp_path}/public")
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/public").collect()} == {1: "a", 2: None}


def test_chunk_files_and_bakes(spark, tmp_path):
    for name, n in (("a", 2), ("b", 1)):
        write(tmp_path / f"{name}.json", json.dumps({"file": f"{name}.pdf", "chunks": [{"i": i, "pages": [1, i], "text": f"{name}{i}"} for i in range(n)]}))
    chunks = readers.chunk_files(spark, f"{tmp_path}/*.json")
    assert sorted((r.file, r.i, r.text) for r in chunks.collect()) == [("a.pdf", 0, "a0"), ("a.pdf", 1, "a1"), ("b.pdf", 0, "b0")]
    rows = [("a.pdf", 0, [3.0, 4.0]), ("a.pdf", 1, [0.0, 2.0]), ("b.pdf", 0, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "file string, i int, embedding array<double>")
    assert {(r.file, r.i): tuple(r.embedding) for r in readers.bake(chunks, vectors).collect()} == {("a.pdf", 0): (0.6, 0.8), ("a.pdf", 1): (0.0, 1.0), ("b.pdf", 0): (1.0, 0.0)}
    with pytest.raises(Exception, match="2 chunks and 1 vectors"):
        readers.bake(chunks, vectors.where("i = 0")).collect()
    assert {(r.file, r.i) for r in readers.aligned(vectors, vectors.where("file = 'b.pdf' or i = 0")).collect()} == {("b.pdf", 0)}
    write(tmp_path / "c.json", "{not json")
    with pytest.raises(Exception):
        readers.chunk_files(spark, f"{tmp_path}/*.json").collect()


def test_pruning_and_projection(spark, tmp_path):
    df = spark.createDataFrame([(i, f"f{i}") for i in range(20)], "doc_id long, file string")
    lines = []
    for k, rows in enumerate((df, df.orderBy(F.desc("doc_id")).repartition(3))):
        writers.json_gzip(rows, f"{tmp_path}/j{k}", "doc_id")
        lines.append([r.value for r in spark.read.text(f"{tmp_path}/j{k}").collect()])
    assert sorted(lines[0]) == sorted(lines[1]) and len(lines[0]) == 20 and list((tmp_path / "j0").glob("*.json.gz"))
    assert {r.file for r in writers.prune(df, df.where("doc_id < 18")).collect()} == {"f18", "f19"}
    writers.projected(df, f"{tmp_path}/index", {"doc_id": "id", "file": "name"}, tiers=["strict", "family", "a"], separator=";")
    facts = spark.read.parquet(f"{tmp_path}/index/facts").first()
    assert spark.read.parquet(f"{tmp_path}/index/documents").columns == ["id", "name"] and list(facts.tiers) == ["strict", "family", "a"] and facts.separator == ";"


def test_served_trees_notes_and_content(spark):
    from folioscope.operators import gates

    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = gates.served(paths("a", "b", "x.map"), paths("a", "c"), r"\.map$").collect()
    assert sorted(map(tuple, got)) == [("b", "stray"), ("c", "missing")]
    versions = spark.createDataFrame([("1.0",), ("2.0",)], "version string")
    notes = spark.createDataFrame([("1.0", 1, "en"), ("1.0", 1, "fr"), ("1.0", 2, "en")], "version string, n int, language string")
    assert sorted(map(tuple, gates.noted(versions, notes, ("en", "fr")).collect()), key=str) == [("1.0", 2, "a language is missing"), ("2.0", None, "no notes")]
    assert gates.same_content(versions, versions.orderBy(F.desc("version"))) and not gates.same_content(versions, versions.limit(1))
    assert gates.issuers({"who": "W.O", "any": "."}, ["plain prose"]) == ["any"]
