"""Sources with explicit schemas: tables in text, verdict logs, candidate dumps, lists, release notes."""

from __future__ import annotations

import tomllib

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

def tsv(spark: SparkSession, path: str, columns: list[str], *, quoted: bool = True) -> DataFrame:
    """A tab-separated table with a header: all strings, a short row's missing cells empty, further cells dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("multiLine", quoted).option("mode", "PERMISSIVE").option("enforceSchema", True)
    reader = reader.option("quote", '"').option("escape", '"') if quoted else reader.option("quote", "")
    return reader.csv(path).na.fill("")

def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file with their numbers, from 1. The file is read whole: for lists and logs, not corpora."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)

def commented_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table whose blank lines and lines with # in front are skipped; a row of another width is an error."""
    lines = numbered(spark, path).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    head = lines.orderBy("n").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    names = head.line.split("\t")
    cells = F.split("line", "\t")
    sound = F.assert_true(F.size(cells) == len(names), F.concat(F.lit("line "), F.col("n").cast("string"), F.lit(" has another number of cells")))
    rows = lines.where((F.col("n") > head.n) & sound.isNull())
    return rows.select(*(F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(names)))

def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")

def verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts q, d, n, s: the last line of each q, d, n; the lines that can't be parsed)."""
    lines = numbered(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("v", F.from_json("line", "q string, d string, n int, s double, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("v is not null and v._bad is null and v.q is not null and v.d is not null")
    bad = parsed.where("v is null or v._bad is not null or v.q is null or v.d is null").select("n", "line")
    return last_of_each(good.select(F.col("n").alias("_line"), "v.q", "v.d", "v.n", "v.s"), ["q", "d", "n"], "_line").drop("_line"), bad

CANDIDATE = "array<struct<rank:int,doc:int,file:string,chunk:int,pages:array<int>,score:double,text_sha:string,text:string>>"

def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each candidate of each query of each strategy's dump (path/STRATEGY/candidates.json)."""
    schema = f"strategy string, topk int, queries array<struct<query_id:string,query:string,type:string,query_lang:string,gold_rank:int,candidates:{CANDIDATE}>>"
    dumps = spark.read.schema(schema).option("multiLine", True).json(path)
    each = dumps.select("strategy", F.explode("queries").alias("q")).select("strategy", "q.query_id", "q.query", "q.type", "q.query_lang", "q.gold_rank", F.explode_outer("q.candidates").alias("c"))
    return each.select(*(c for c in each.columns if c != "c"), "c.*")

def names(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed name a line."""
    return spark.read.text(path).select(F.trim("value").alias("file")).where("file <> ''").distinct()

def only(frame: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows that a name list restricts a run to."""
    return frame.join(listed, "file", "left_semi")

def release_notes(spark: SparkSession, path: str) -> DataFrame:
    """version, category, n and bullet: each bullet under the headings it stands below."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda p: F.last(F.when(F.regexp_extract("line", p, 1) != "", F.regexp_extract("line", p, 1)), ignorenulls=True).over(w)
    lines = numbered(spark, path).withColumn("version", carry(r"^## \[?([0-9]+\.[0-9]+\.[0-9]+)")).withColumn("category", carry(r"^### (.+)$"))
    return lines.where(F.col("line").rlike(r"^[-*] ") & F.col("version").isNotNull()).select("version", "category", "n", F.regexp_extract("line", r"^[-*] (.*)$", 1).alias("bullet"))

def version_key(version):
    """major.minor.patch as an array of integers, which sorts."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))

def config(path: str, *sections: str) -> dict:
    """A TOML file on the driver; a section that is missing is an error."""
    found = tomllib.loads(Path(path).read_text())
    if missing := [s for s in sections if s not in found]:
        raise ValueError(f"{path} has no section {', '.join(missing)}")
    return found


CHUNKS = "array<struct<i:int,pages:array<int>,text:string,figure:boolean>>"

def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk of one-document JSON files (path/*.json): file, i, pages, text, figure. A file that can't be read
    is an error, as a document that is silently missing would be one."""
    files = spark.read.schema(f"file string, chunks {CHUNKS}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    named = F.assert_true(F.col("file").isNotNull(), "a chunk file names no document")
    return files.where(named.isNull()).select("file", F.explode("chunks").alias("c")).select("file", "c.*")

def bake(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (file, i) with their unit vectors (file, i, embedding); a file whose counts differ on the two sides is an error."""
    from folioscope.functions.vectors import unit

    sides = chunks.select("file", F.lit(1).alias("a"), F.lit(0).alias("b")).union(vectors.select("file", F.lit(0), F.lit(1)))
    counts = sides.groupBy("file").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sound = F.assert_true(F.col("a") == F.col("b"), F.concat(F.col("file"), F.lit(": "), F.col("a"), F.lit(" chunks and "), F.col("b"), F.lit(" vectors")))
    checked = counts.where(sound.isNull()).select("file")
    return chunks.join(vectors.withColumn("embedding", unit(F.col("embedding"))), ["file", "i"]).join(checked, "file", "left_semi")

def aligned(one: DataFrame, other: DataFrame) -> DataFrame:
    """The vectors (file, i, embedding) that two bakes both have, as embedding and other; files of unequal counts are left out."""
    counts = lambda d, n: d.groupBy("file").agg(F.count("*").alias(n))
    same = counts(one, "a").join(counts(other, "b"), "file").where("a = b").select("file")
    return one.join(other.withColumnRenamed("embedding", "other"), ["file", "i"]).join(same, "file", "left_semi")
