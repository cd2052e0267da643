"""Boxes of lines on pages: (x0, y0, x1, y1) in points, and what layout asks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .layout import in_order


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def common(a: Column, b: Column) -> Column:
    """The box that two boxes share; without area if they don't meet."""
    return F.struct(
        F.greatest(a["x0"], b["x0"]).alias("x0"), F.greatest(a["y0"], b["y0"]).alias("y0"),
        F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"),
    )


def overlap_share(a: Column, b: Column) -> Column:
    """The shared area as a share of the smaller box."""
    return area(common(a, b)) / F.nullif(F.least(area(a), area(b)), F.lit(0.0))


def contains(box: Column, x: Column, y: Column, slack: float = 1.0) -> Column:
    return x.between(box["x0"] - slack, box["x1"] + slack) & y.between(box["y0"] - slack, box["y1"] + slack)


def cell(cuts: list[float], x: Column) -> Column:
    """How many cuts are at or before ``x``: the column a word stands in."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= x))


def margin_after(margins: list[float], x: Column) -> Column:
    """The first margin at or beyond ``x``; null without one."""
    return F.array_min(F.filter(F.array(*map(F.lit, margins)), lambda m: m >= x))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def pitch(rows: DataFrame) -> DataFrame:
    """Each document's upper median distance between lines that follow each other on a page."""
    step = F.when(F.lag("page").over(in_order()) == F.col("page"), F.col("box.y0") - F.lag("box.y0").over(in_order()))
    steps = rows.withColumn("step", step).where("step > 0")
    return steps.groupBy("doc_id").agg(upper_median(F.collect_list("step")).alias("pitch"))


def runs(rows: DataFrame, by: str, order: str, mark: str, text: str) -> DataFrame:
    """Neighbouring rows with the same mark as one, their texts joined in order."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce(F.lag(mark).over(w) != F.col(mark), F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return numbered.groupBy(by, "run").agg(F.first(mark).alias(mark), F.array_join(F.transform(ordered, lambda s: s[text]), " ").alias(text), F.count("*").alias("n"))


#: Fixed values of table and flow tests: least columns, filled cells, rows with several values; a margin's width, lines and share; room beyond a word.
TABLE_COLUMNS, TABLE_FILL, TABLE_ROWS = 2, 0.4, 0.6
MARGIN_WIDTH, MARGIN_LINES, MARGIN_SHARE = 3.0, 4, 0.08
SAME_LINE, ROOM, SIDE = 0.5, 1.25, 1.0


def tabular(filled: Column, width: Column) -> Column:
    """An aggregate: whether rows with ``filled`` cells of ``width`` make a table."""
    columns = F.max(width)
    return (columns >= TABLE_COLUMNS) & (F.sum(filled) / (F.count("*") * columns) >= TABLE_FILL) & (F.count_if(filled > 1) / F.count("*") >= TABLE_ROWS)


def clip(box: Column, page: Column) -> Column:
    """The box cut to the page, and its fate: kept, clipped, or dropped where less than a point is left of a side."""
    inside = common(box, page)
    whole = (box["x0"] >= page["x0"]) & (box["y0"] >= page["y0"]) & (box["x1"] <= page["x1"]) & (box["y1"] <= page["y1"])
    thin = (inside["x1"] - inside["x0"] < SIDE) | (inside["y1"] - inside["y0"] < SIDE)
    return F.struct(F.when(whole, "kept").when(thin, "dropped").otherwise("clipped").alias("fate"), inside.alias("box"))


def rounded(box: Column) -> Column:
    """Whole points, halves to even."""
    return F.struct(*(F.rint(box[c]).alias(c) for c in ("x0", "y0", "x1", "y1")))


def same_line(a: Column, b: Column) -> Column:
    """Whether two upright boxes stand on one visual line."""
    shorter = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (shorter > 0) & ((F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])) / shorter > SAME_LINE)


def margins(ends: Column) -> Column:
    """Structs (margin, n) of the sorted ``ends``: groups that begin with an end and take those near it, if large enough."""
    none = F.array().cast("array<struct<margin:double,n:int>>")
    least = F.greatest(F.lit(MARGIN_LINES), F.floor(F.size(ends) * MARGIN_SHARE))
    one = lambda s: F.struct(s["last"].alias("margin"), s["n"].alias("n"))
    closed = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(one(s)))).otherwise(s["out"])

    def take(state: Column, end: Column) -> Column:
        near = (state["n"] > 0) & (end - state["first"] <= MARGIN_WIDTH)
        return F.struct(
            F.when(near, state["first"]).otherwise(end).alias("first"), end.alias("last"), F.when(near, state["n"] + 1).otherwise(1).alias("n"),
            F.when(near, state["out"]).otherwise(closed(state)).alias("out"),
        )

    start = F.struct(F.lit(0.0).alias("first"), F.lit(0.0).alias("last"), F.lit(0).alias("n"), none.alias("out"))
    return F.filter(F.aggregate(ends, start, take, closed), lambda m: m["n"] >= least)


def broken(rows: DataFrame, right: float) -> DataFrame:
    """``ended``: whether the line before left room up to ``right`` for this line's first word and a quarter more."""
    room = right - F.lag("box.x1").over(in_order())
    width = (F.col("box.x1") - F.col("box.x0")) / F.length("line")
    needed = (F.length(F.get(F.split("line", " "), F.lit(0))) + 1) * width * ROOM
    fits = (F.lag("page").over(in_order()) == F.col("page")) & (room > 0) & (room >= needed)
    return rows.withColumn("ended", F.coalesce(fits, F.lit(False)))
