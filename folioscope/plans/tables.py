"""Queries over boxes and grids: visual lines, margins, line ends, cells."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioscope.functions import text as t
from folioscope.operators import geometry as g, layout as l

from .base import Tables, query
from .geometry import _BOX, boxed
from .texts import _LINES

_CELLS = f"(SELECT doc_id, page, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '') AS filled, len(string_split(line, '|')) AS width FROM {_LINES} WHERE position('|' IN line) > 0)"


@query(f"SELECT doc_id, page, max(width) AS columns, max(width) >= 2 AND sum(len(filled)) / (count(*) * max(width)) >= 0.4 AND count(*) FILTER (WHERE len(filled) > 1) / count(*) >= 0.6 AS tabular FROM {_CELLS} GROUP BY doc_id, page")
def tabular_pages(x: Tables):
    """Whether the rows with cell marks of a page look like a table: filled enough, and with several values in most rows."""
    rows = l.lines(x.documents).where(F.contains("line", F.lit("|")))
    cells = rows.select("doc_id", "page", F.size(t.cell_values(F.col("line"), r"\|")).alias("filled"), F.size(F.split("line", r"\|")).alias("width"))
    return cells.groupBy("doc_id", "page").agg(F.max("width").cast("long").alias("columns"), g.tabular(F.col("filled"), F.col("width")).alias("tabular"))


@query(f"SELECT doc_id, seq, CASE WHEN x0 >= 0 AND y0 >= 0 AND x1 <= 400 AND y1 <= 140 THEN 'kept' WHEN least(x1, 400) - greatest(x0, 0) < 1 OR least(y1, 140) - greatest(y0, 0) < 1 THEN 'dropped' ELSE 'clipped' END AS fate, least(x1, 400) AS x1 FROM {_BOX}")
def clipped_boxes(x: Tables):
    """What becomes of each line's box when it is cut to a page of 400 by 140 points."""
    page = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(140.0).alias("y1"))
    cut = g.clip(F.col("box"), page)
    return boxed(x).select("doc_id", "seq", cut["fate"].alias("fate"), cut["box"]["x1"].alias("x1"))


@query(f"SELECT doc_id, page, len(list(DISTINCT [round_even(x0 / 8, 0), round_even(y0 / 8, 0), round_even(x1 / 8, 0), round_even(y1 / 8, 0)])) AS boxes, count(*) AS lines FROM {_BOX} GROUP BY doc_id, page")
def rounded_boxes(x: Tables):
    """Different boxes on each page, in whole units of eight points, halves to even."""
    unit = F.struct(*((F.col(f"box.{c}") / 8).alias(c) for c in ("x0", "y0", "x1", "y1")))
    rows = boxed(x).select("doc_id", "page", g.rounded(unit).alias("box"))
    return rows.groupBy("doc_id", "page").agg(F.countDistinct("box").alias("boxes"), F.count("*").alias("lines"))


_TALL = f"(SELECT doc_id, page, seq, x0, x1, 100.0 + 4 * (seq % 4) AS y0, 106.0 + 4 * (seq % 4) + seq % 3 AS y1 FROM {_BOX})"


@query(f"SELECT a.doc_id, a.seq, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) > 0.5 AS same FROM {_TALL} a JOIN {_TALL} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq + 1 = b.seq")
def same_visual_line(x: Tables):
    """Whether a line and the next overlap across the direction of reading by more than half of the shorter."""
    low = 4 * (F.col("seq") % 4)
    rows = boxed(x).withColumn("box", F.struct(F.col("box.x0").alias("x0"), (100.0 + low).alias("y0"), F.col("box.x1").alias("x1"), (106.0 + low + F.col("seq") % 3).alias("y1")))
    after = rows.select("doc_id", "page", (F.col("seq") - 1).alias("seq"), F.col("box").alias("other"))
    return rows.join(after, ["doc_id", "page", "seq"]).select("doc_id", "seq", g.same_line(F.col("box"), F.col("other")).alias("same"))


_ENDS = f"(SELECT doc_id, 72 + 0.7::DOUBLE * length(line) AS x1 FROM {_LINES})"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_ENDS}), a AS (SELECT doc_id, min(x1) AS anchor FROM e GROUP BY doc_id UNION ALL
SELECT a.doc_id, min(e.x1) FROM a JOIN e ON e.doc_id = a.doc_id AND e.x1 - a.anchor > 3 GROUP BY a.doc_id),
m AS (SELECT a.doc_id, anchor, count(*) AS n, max(x1) AS margin FROM a JOIN e ON e.doc_id = a.doc_id AND e.x1 >= anchor AND e.x1 - anchor <= 3 GROUP BY a.doc_id, anchor),
s AS (SELECT doc_id, greatest(4, CAST(floor(count(*) * 0.08) AS BIGINT)) AS least FROM e GROUP BY doc_id)
SELECT doc_id, round(margin, 6) AS margin, n FROM m JOIN s USING (doc_id) WHERE n >= least""")
def flow_margins(x: Tables):
    """Where lines of a document habitually end: groups of ends within three points of the group's first."""
    ends = l.lines(x.documents).groupBy("doc_id").agg(F.sort_array(F.collect_list(72 + 0.7 * F.length("line"))).alias("ends"))
    found = ends.select("doc_id", F.explode(g.margins(F.col("ends"))).alias("m"))
    return found.select("doc_id", F.round("m.margin", 6).alias("margin"), F.col("m.n").cast("long").alias("n"))


@query(f"SELECT doc_id, seq, coalesce(page = back_page AND 502 - back_x1 > 0 AND 502 - back_x1 >= (length(string_split(line, ' ')[1]) + 1) * (x1 - x0) / length(line) * 1.25, false) AS ended FROM (SELECT *, lag(page) OVER w AS back_page, lag(x1) OVER w AS back_x1 FROM {_BOX} WINDOW w AS (PARTITION BY doc_id ORDER BY seq))")
def line_break_flags(x: Tables):
    """Whether the line before was ended by its author: the next word would have fitted on it."""
    return g.broken(boxed(x), 502.0).select("doc_id", "seq", "ended")


_WORDS = f"(SELECT doc_id, seq, k, word, 72 + 5 * (sum(length(word) + 1) OVER (PARTITION BY doc_id, seq ORDER BY k) - length(word) - 1) AS place FROM (SELECT doc_id, seq, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM {_LINES} WHERE position('|' IN line) > 0))"


@query(f"SELECT doc_id, seq, len(list_filter([150.0, 250.0, 350.0], lambda c: c <= place)) AS cell, string_agg(word, ' ' ORDER BY k) AS text FROM {_WORDS} GROUP BY doc_id, seq, cell")
def grid_cells(x: Tables):
    """The words of table rows in the columns that three cuts make, a word standing in that of its start."""
    rows = l.lines(x.documents).where(F.contains("line", F.lit("|"))).select("doc_id", F.col("seq").cast("long").alias("seq"), F.posexplode(F.split("line", " ")).alias("k", "word"))
    before = Window.partitionBy("doc_id", "seq").orderBy("k")
    at = 72 + 5 * (F.sum(F.length("word") + 1).over(before) - F.length("word") - 1)
    placed = rows.withColumn("cell", g.cell([150.0, 250.0, 350.0], at).cast("long"))
    words = F.array_sort(F.collect_list(F.struct("k", "word")))
    return placed.groupBy("doc_id", "seq", "cell").agg(F.array_join(F.transform(words, lambda s: s["word"]), " ").alias("text"))
