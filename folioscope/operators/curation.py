"""Reviews, queues, titles, templates, hashes and batch plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Little words of two languages.
FRENCH = "de la le les des et du une un est pour dans par au aux sur avec ou ce cette sont plus".split()
ENGLISH = "the of and to in for is with that on are as at by from this be or an was".split()
#: Least characters of a page with text, least drawn share, answers of a reviewer, a row's price in MiB by length.
LEAST_PAGE, DRAWN, CONFIDENCE = 50, 0.15, ("high", "medium", "low")
LINEAR_MIB, SQUARE_BYTES = 0.06, 96


def figure_range(mode: Column, offset: Column, count: Column, figures: Column) -> Column:
    """Struct (first, beyond) of the rows that a figure mode lets be scored."""
    end = offset + count
    first = F.when(mode.isin("only", "tables", "images"), end - figures).otherwise(offset)
    return F.struct(first.alias("first"), F.when(mode == "exclude", end - figures).otherwise(end).alias("beyond"))


def stratum(captions: Column, big: Column, share: Column, page: Column) -> Column:
    return F.when((captions > 0) & ((big > 0) | (share >= DRAWN)), "captioned").when((big > 0) & (page > 1), "raster")


def ocr_need(pages: DataFrame) -> DataFrame:
    """need and pages of each document; ``pages`` has doc_id, thin (too little text) and content (something else is there)."""
    full, some = F.count_if(~F.col("thin")) == 0, F.count_if(F.col("thin") & F.col("content"))
    return pages.groupBy("doc_id").agg(F.when(full, "full").when(some > 0, "partial").otherwise("none").alias("need"), F.when(full, F.count("*")).otherwise(some).alias("pages"))


def problems(cell: Column, vocabulary: list[str], confidence: Column, note: Column, before: Column, separator: str = ";") -> Column:
    """Names of all that is wrong with a decision."""
    held = F.trim(cell)
    values = F.transform(F.split(held, separator), lambda v: F.trim(v))
    known = F.array(*map(F.lit, vocabulary))
    tests = {
        "blank": held == "", "empty": (held != "") & F.exists(values, lambda v: v == ""),
        "unknown": F.exists(values, lambda v: (v != "") & ~F.array_contains(known, v)),
        "repeated": (held != "") & (F.size(F.array_distinct(values)) != F.size(values)),
        "confidence": ~F.trim(confidence).isin(*CONFIDENCE), "note": (held != before) & (F.trim(note) == ""),
    }
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))


def looks_french(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-öø-ÿ']+"), F.lit(0))
    hits = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    return hits(FRENCH) >= hits(ENGLISH)


def percentiles(counts: DataFrame, value: str, n: str, places: tuple[float, ...]) -> DataFrame:
    """p and the value at place ``floor(p * n)`` of the sorted order.

    Running totals are made within ranges of values first, so that no task gets all of them.
    """
    ranged = counts.withColumn("_range", F.floor(F.col(value) * 64))
    inside = ranged.withColumn("_upto", F.sum(n).over(Window.partitionBy("_range").orderBy(value)))
    sums = ranged.groupBy("_range").agg(F.sum(n).alias("_n"))
    before = sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = inside.join(F.broadcast(before), "_range").withColumn("_upto", F.col("_upto") + F.col("_before"))  # a row for each range: bounded by the scores' span
    each = placed.withColumn("p", F.explode(F.array(*map(F.lit, places))))
    wanted = F.least(F.col("_all") - 1, F.floor(F.col("p") * F.col("_all")))
    return each.where(F.col("_upto") > wanted).groupBy("p").agg(F.min(value).alias(value))


def queue_rank(name: Column, restricted: Column, first: list[str], last: list[str]) -> tuple[Column, Column]:
    """(place by patterns, whether the document stands behind its equals)."""
    rank = reduce(lambda out, k: out.when(name.rlike(first[k]), k), range(1, len(first)), F.when(name.rlike(first[0]), 0))
    any_last = reduce(lambda a, b: a | b, (name.rlike(p) for p in last))
    named = reduce(lambda a, b: a | b, (name.rlike(p) for p in [*first, *last]))
    return rank.when(any_last, len(first) + 1).otherwise(len(first)), ~named & restricted


def token_hits(rows: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, start, stop and word of each whole token among ``terms``; ``rows`` has doc_id and a folded text."""
    near = rows.where(F.col("text").rlike("|".join(terms)))
    cut = near.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)).alias("word"), F.split("text", "[a-z0-9]+", -1).alias("gap"))).alias("k", "x"))
    words = cut.select("doc_id", "k", "x.*").where("word IS NOT NULL")
    start = F.sum(F.length("gap") + F.length("word")).over(Window.partitionBy("doc_id").orderBy("k")) - F.length("word")
    return words.withColumn("start", start).where(F.col("word").isin(*terms)).select("doc_id", "start", (F.col("start") + F.length("word")).alias("stop"), "word")


_LETTER = "a-zàâçéèêëîïôûùüÿñæœ"


def normalised(text: Column) -> Column:
    """Soft hyphens and line-end hyphens gone, blanks single, soft line ends as blanks, paragraphs kept."""
    out = F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), f"-\n(?=[{_LETTER}])", "")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{2,}", "\n")
    out = F.regexp_replace(out, rf"(?<![.!?:;])\n(?=[{_LETTER}(])", " ")
    return F.regexp_replace(F.regexp_replace(out, r"^\s+", ""), r"\s+$", "")


def clean_title(name: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"^\d{4}-\d{2}-\d{2}[_-]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(stem, "_+", " "), r"\s+", " "), F.lit(" -"))


def human_size(size: Column) -> Column:
    """Decimal megabytes, or kilobytes below one; halves to even."""
    return F.when(size >= 1_000_000, F.format_string("%.1f MB", F.bround(size / 1_000_000, 1))).otherwise(F.format_string("%.0f kB", F.bround(size / 1_000, 0)))


def fill(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{{key}}`` replaced by its value, escaped for HTML."""
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    escaped = lambda c: reduce(lambda out, m: F.replace(out, F.lit(m[0]), F.lit(m[1])), marks, c)
    return reduce(lambda out, k: F.replace(out, F.lit("{{" + k + "}}"), escaped(values[k])), values, F.lit(template))


def window_of(rows: DataFrame, limit: int) -> DataFrame:
    """doc_id and evidence: lines in order until they have ``limit`` characters, cut with an ellipsis."""
    had = F.sum(F.length("line")).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.length("line")
    taken = rows.withColumn("_had", had).where(F.col("_had") < limit)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.rtrim("line").alias("line")))), lambda s: s["line"]), "\n")
    whole = taken.groupBy("doc_id").agg(text.alias("w"))
    return whole.select("doc_id", F.when(F.length("w") > limit, F.concat(F.substring("w", 1, limit), F.lit("..."))).otherwise(F.col("w")).alias("evidence"))


def source_hash(parameters: str, version: str, texts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(parameters), F.lit(version), F.array_join(texts, "\0")), 256)


def with_payload(digest: Column, payload: Column) -> Column:
    """A digest with a payload folded in; unchanged without one."""
    return F.when(payload.isNull(), digest).otherwise(F.sha2(F.concat_ws(":", digest, payload), 256))


def row_cost(width: Column) -> Column:
    """MiB that one row of a call takes at a padded length."""
    return LINEAR_MIB * width + SQUARE_BYTES / (1024.0 * 1024.0) * width * width


def plan_batches(lengths: Column, budget: float, plateau: int = 64) -> Column:
    """Sizes of the calls that rows of ``lengths`` are fed in, each within ``budget`` at its longest row, if it has several."""

    def take(state: Column, length: Column) -> Column:
        wide = F.greatest(state["width"], length, F.lit(1))
        fits = (state["size"] > 0) & (state["size"] < plateau) & ((state["size"] + 1) * row_cost(wide) <= budget)
        closed = F.when(state["size"] > 0, F.concat(state["out"], F.array(state["size"]))).otherwise(state["out"])
        return F.struct(F.when(fits, wide).otherwise(F.greatest(length, F.lit(1))).alias("width"), F.when(fits, state["size"] + 1).otherwise(1).alias("size"), F.when(fits, state["out"]).otherwise(closed).alias("out"))

    start = F.struct(F.lit(0).alias("width"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, take, lambda s: F.when(s["size"] > 0, F.concat(s["out"], F.array(s["size"]))).otherwise(s["out"]))
