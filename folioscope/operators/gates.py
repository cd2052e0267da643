"""Gates: frames of violations, and what refuses to go on while there are any."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


class Refused(RuntimeError):
    """Violations were found; the message has their kinds and the first few."""


def refuse(violations: DataFrame, shown: int = 20) -> None:
    """Raises if there is any violation (kind, where)."""
    if found := violations.orderBy("kind", "where").limit(shown).collect():
        raise Refused("; ".join(f"{r['kind']}: {r['where']}" for r in found))


def violations(frame: DataFrame, where: str, tests: Mapping[str, Column]) -> DataFrame:
    """kind and where: a row for each test that a row fails. One pass over the frame whatever the number of tests."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests.items())))
    return frame.select(F.explode(failed).alias("kind"), F.col(where).cast("string").alias("where"))


def orphans(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys that one side lacks."""
    side = lambda a, b, name: a.select(key).join(b.select(key), key, "left_anti").select(F.lit(f"{name} alone").alias("kind"), F.col(key).cast("string").alias("where"))
    return side(left, right, names[0]).unionByName(side(right, left, names[1]))


def closed(frame: DataFrame, vocabularies: Mapping[str, list[str]], where: str, separator: str = ";") -> DataFrame:
    """Values outside the closed vocabularies of all columns."""
    parts = []
    for column, values in vocabularies.items():
        each = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), separator), lambda v: F.trim(v)), lambda v: v != "")
        unknown = F.array_except(each, F.array(*map(F.lit, values)))
        each = F.transform(unknown, lambda v: F.concat_ws(" ", F.col(where).cast("string"), v))
        parts.append(frame.select(F.lit(f"unknown {column}").alias("kind"), F.explode(each).alias("where")))
    return reduce(DataFrame.unionByName, parts)


def unique(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows have."""
    return frame.groupBy(*keys).count().where("count > 1").select(F.lit("repeated key").alias("kind"), F.concat_ws(" ", *keys).alias("where"))


def tiles(frame: DataFrame, by: str, start: str, size: str) -> DataFrame:
    """Rows whose offset isn't the end of the row before it, within each ``by``."""
    before = F.lag(F.col(start) + F.col(size)).over(Window.partitionBy(by).orderBy(start))
    return frame.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col("_b") != F.col(start))).select(F.lit("gap").alias("kind"), F.concat_ws(" ", by, start).alias("where"))


def boxes_within(frame: DataFrame, box: str, width: float, height: float, where: str, margin: float = 2.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1) without area or off the page."""
    b = lambda i: F.get(box, F.lit(i))
    return violations(frame, where, {
        "degenerate box": (b(2) <= b(0)) | (b(3) <= b(1)),
        "box off the page": (b(0) < -margin) | (b(1) < -margin) | (b(2) > width + margin) | (b(3) > height + margin),
    })


def one_variant(frame: DataFrame, column: str) -> DataFrame:
    """All values of a column, if there are several."""
    n = frame.agg(F.countDistinct(column).alias("n")).where("n > 1")
    return frame.select(F.col(column).cast("string").alias("where")).distinct().join(F.broadcast(n)).select(F.lit(f"several {column}").alias("kind"), "where")


def fill_blanks(frame: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Blank cells take the derived value; ``-``, which says that there is none, stays."""
    return frame.select(*(F.coalesce(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")), derived[c], F.lit("")).alias(c) if c in derived else F.col(c) for c in frame.columns))


def review(rows: DataFrame, decisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the decisions' values, where one has been made and isn't blank."""
    d = decisions.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    out = rows.join(d, key, "left")
    return out.select(*(F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def unreviewed(rows: DataFrame, log: DataFrame, key: str, batch: int) -> DataFrame:
    """The next batch of rows without a decision, by key."""
    return rows.join(log.select(key), key, "left_anti").orderBy(key).limit(batch)


def served(listed: DataFrame, wanted: DataFrame, allowed: str, key: str = "path") -> DataFrame:
    """What is wrong with a served tree: ``missing`` files, and ``stray`` ones that are neither wanted nor match ``allowed``."""
    missing = wanted.select(key).join(listed, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    stray = listed.select(key).join(wanted, key, "left_anti").where(~F.col(key).rlike(allowed)).select(key, F.lit("stray").alias("problem"))
    return missing.unionByName(stray)


def noted(versions: DataFrame, notes: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Versions without notes, and bullets that lack a language; ``notes`` has version, n and language."""
    without = versions.join(notes, "version", "left_anti").select("version", F.lit(None).cast("int").alias("n"), F.lit("no notes").alias("problem"))
    held = notes.groupBy("version", "n").agg(F.collect_set("language").alias("_held"))
    lacking = held.where(F.size(F.array_except(F.array(*map(F.lit, languages)), "_held")) > 0).select("version", "n", F.lit("a language is missing").alias("problem"))
    return without.unionByName(lacking)


def same_content(stored: DataFrame, made: DataFrame) -> bool:
    """Whether a stored table is what would be made now, by content and not by order."""
    from folioscope.sources.writers import content_version

    return sorted(stored.columns) == sorted(made.columns) and content_version(stored) == content_version(made.select(stored.columns))


def issuers(patterns: dict[str, str], prose: list[str]) -> list[str]:
    """Names whose pattern matches innocent prose; tables of patterns are checked when they are read."""
    import re

    return sorted(name for name, p in patterns.items() if any(re.search(p, text) for text in prose))
