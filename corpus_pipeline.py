"""The corpus pipeline: documents through quality, near duplicates, decontamination, secrets and token ids.

Each stage works on all that the one before kept; each result is written to the shared folder and read again. Documents
that the classifier rejects, all but the smallest doc_id of each group of near duplicates, and documents that hold a benchmark
window go; benchmark items too short for a window are cut out of the texts that stay; secrets are replaced by a mark; the last stage gives ids, their number, and whether they decode to the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import decontaminate, jaccard, pieces, quality, secrets
from folioscope.llm.common import table, work_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").select(docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles over links."""
    return jaccard.first_of_each(docs, n=5, percent=80)


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if it has them, counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with no 13 words in a row from a benchmark item and less than a twentieth of words from shorter items, which
    are cut out."""
    return counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))).select(docs.columns)


def unlocked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    return counted(secrets.redact(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' ids, with an end id; ``round_trip``: they decode to the text."""
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    others = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    return coded.select(*others, F.size("ids").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", unseen),
    ("secret scans", unlocked),
    ("SentencePiece encoding and decoding", encoded),
]
#: The stages classify, join and encode beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
