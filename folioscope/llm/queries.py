"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, fixity, jaccard, neighbours, pieces, quality, secrets, suffixes, tokenfiles
from .common import table, work_path
from .oracles import ORACLE_SQL  # noqa: F401


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")), keep=["doc_id"])


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digests=True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scan(docs, bench, keep=["doc_id"]), ["doc_id"])


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_conversations(turns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = fixity.as_records(pages, F.floor(F.col("page_id") / 128).alias("archive"), F.col("page_id"), F.col("url"), F.col("html"))
    return fixity.audit(fixity.laid_out(fixity.measure(fixity.damaged(records)), "replica"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(neighbours.index(rows), rows.where("vec_id % 20 = 0"))


def op9_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "tokenfiles")
    tokenfiles.write(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read(spark, out, arrays=False)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pieces": op2_pieces,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat": op4_chat,
    "op5_jaccard": op5_jaccard,
    "op6_fixity": op6_fixity,
    "op7_secrets": op7_secrets,
    "op8_neighbours": op8_neighbours,
    "op9_tokenfiles": op9_tokenfiles,
    "op10_suffixes": op10_suffixes,
}
