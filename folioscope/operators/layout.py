"""Operators over a document's lines: repeated lines, breaks, lists, headings, sections and pages.

A frame of lines has doc_id, seq (from 0), and line. Pages are runs of ``page_lines`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions import text as t

def in_order():
    return Window.partitionBy("doc_id").orderBy("seq")


def own_ids(documents: DataFrame) -> bool:
    """Whether each row has an id that no other row has. Ids alone are read, when the plan is made."""
    return documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def lines(documents: DataFrame, page_lines: int = 4) -> DataFrame:
    """Each non-empty line with its place and page."""
    each = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).where(F.trim("line") != "")
    return each.withColumn("page", F.floor(F.col("seq") / page_lines).cast("int") + 1)


def boilerplate(rows: DataFrame, share: float = 0.35, least_pages: int = 6) -> DataFrame:
    """doc_id and key of lines that stand, digits aside, on many of a document's pages."""
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least_pages)
    keys = rows.withColumn("key", t.digit_key(F.col("line"))).groupBy("doc_id", "key").agg(F.countDistinct("page").alias("on"))
    return keys.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.floor(share * F.col("pages")))).select("doc_id", "key", "on")


def without_boilerplate(rows: DataFrame, **options) -> DataFrame:
    return rows.withColumn("key", t.digit_key(F.col("line"))).join(boilerplate(rows, **options), ["doc_id", "key"], "left_anti").drop("key")


def is_heading(line: Column) -> Column:
    """A short line without final punctuation that begins with a capital."""
    trimmed = F.trim(line)
    return (F.length(trimmed) <= 60) & ~trimmed.rlike(r"[.!?:;,|]$") & trimmed.rlike("^[A-Z]")


def breaks(rows: DataFrame) -> DataFrame:
    """``rows`` with the strength of the break before each: 3 a page or heading, 2 a list item, 1 a sentence's end, else 0."""
    last_page, last_line = F.lag("page").over(in_order()), F.lag("line").over(in_order())
    strength = (
        F.when(last_line.isNull() | (last_page != F.col("page")) | is_heading(F.col("line")), 3)
        .when(t.is_item(F.col("line")), 2).when(t.ends_sentence(last_line), 1).otherwise(0)
    )
    return rows.withColumn("strength", strength)


def in_list(rows: DataFrame) -> DataFrame:
    """``rows`` with whether a list goes on: from an item to the next page's start."""
    mark = F.when(t.is_item(F.col("line")), True).when(F.lag("page").over(in_order()) != F.col("page"), False)
    return rows.withColumn("_mark", mark).withColumn("listed", F.coalesce(F.last("_mark", ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).drop("_mark")


def sections(rows: DataFrame) -> DataFrame:
    """``rows`` with section (how many heading runs have begun) and heading (the run's first line)."""
    marked = rows.withColumn("_head", is_heading(F.col("line")))
    starts = F.col("_head") & ~F.coalesce(F.lag("_head").over(in_order()), F.lit(False))
    marked = marked.withColumn("_start", starts)
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    section = F.sum(F.col("_start").cast("int")).over(upto)
    heading = F.last(F.when(F.col("_start"), F.col("line")), ignorenulls=True).over(upto)
    return marked.withColumn("section", section).withColumn("heading", heading).drop("_head", "_start")


def joined(rows: DataFrame, *keys: str) -> DataFrame:
    """The lines of each group in order, as one text with as many lines."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return rows.groupBy("doc_id", *keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_lines"))


def majority(boxes: DataFrame, sections_: DataFrame, on: list[str], chunk: str, section: str) -> DataFrame:
    """The section that shares most boxes with each chunk; ties to the smaller, none without a shared box."""
    votes = boxes.join(sections_, on).groupBy(chunk, section).agg(F.count("*").alias("votes"))
    best = votes.groupBy(chunk).agg(F.max_by(F.struct(section, "votes"), F.struct("votes", -F.col(section))).alias("b")).select(chunk, "b.*")
    return boxes.select(chunk).distinct().join(best, chunk, "left")
