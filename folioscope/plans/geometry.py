"""Queries over lines as boxes on pages, tables in text, sections and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import geometry as g, layout as l, ranking as r

from .base import Tables, query
from .texts import _HEAD, _LINES

_BOX = f"(SELECT *, 72.0::DOUBLE AS x0, 100.0 + 12 * (seq % 4) AS y0, 72.0 + least(430, length(line) * 5) AS x1, 110.0 + 12 * (seq % 4) + seq % 3 AS y1 FROM {_LINES})"
CUTS, MARGINS = [100.0, 200.0, 300.0, 400.0], [120.0, 250.0, 380.0, 480.0]


def boxed(x: Tables):
    rows = l.lines(x.documents)
    seq = F.col("seq")
    box = F.struct(F.lit(72.0).alias("x0"), (100.0 + 12 * (seq % 4)).alias("y0"), (72.0 + F.least(F.lit(430), F.length("line") * 5)).alias("x1"), (110.0 + 12 * (seq % 4) + seq % 3).alias("y1"))
    return rows.withColumn("box", box).withColumn("seq", seq.cast("long"))


@query(f"SELECT a.doc_id, a.seq, round(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 6) AS share FROM {_BOX} a JOIN {_BOX} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq + 1 = b.seq")
def overlap_shares(x: Tables):
    """How far each line's box meets the next one's."""
    a = boxed(x)
    b = a.select("doc_id", "page", (F.col("seq") - 1).alias("seq"), F.col("box").alias("other"))
    return a.join(b, ["doc_id", "page", "seq"]).select("doc_id", "seq", F.round(g.overlap_share(F.col("box"), F.col("other")), 6).alias("share"))


@query(f"SELECT doc_id, seq, CAST(len(list_filter([100.0, 200.0, 300.0, 400.0], lambda c: c <= x1)) AS INTEGER) AS cell, list_min(list_filter([120.0, 250.0, 380.0, 480.0], lambda m: m >= x1))::DOUBLE AS margin FROM {_BOX}")
def cells_and_margins(x: Tables):
    """The table column that a line's end stands in, and the first margin beyond it."""
    return boxed(x).select("doc_id", "seq", g.cell(CUTS, F.col("box.x1")).alias("cell"), g.margin_after(MARGINS, F.col("box.x1")).alias("margin"))


@query(f"SELECT p.doc_id, p.seq, count(*) AS n FROM {_BOX} p JOIN {_BOX} b ON b.doc_id = p.doc_id AND b.page = p.page AND p.x1 BETWEEN b.x0 - 1 AND b.x1 + 1 AND p.y0 BETWEEN b.y0 - 1 AND b.y1 + 1 GROUP BY p.doc_id, p.seq")
def points_in_boxes(x: Tables):
    """Boxes of the page that hold each line's end."""
    a = boxed(x)
    points = a.select("doc_id", "page", "seq", F.col("box.x1").alias("px"), F.col("box.y0").alias("py"))
    return points.join(a.select("doc_id", "page", "box"), ["doc_id", "page"]).where(g.contains(F.col("box"), F.col("px"), F.col("py"))).groupBy("doc_id", "seq").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, list_sort(list(step))[len(list(step)) // 2 + 1] AS pitch FROM (SELECT doc_id, CASE WHEN lag(page) OVER w = page THEN y0 - lag(y0) OVER w END AS step FROM {_BOX} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE step > 0 GROUP BY doc_id")
def line_pitch(x: Tables):
    """Each document's usual distance between lines."""
    return g.pitch(boxed(x))


_REASON = "CASE WHEN n_chars < 700 THEN 'short' WHEN len(regexp_extract_all(text, '[A-Za-z]')) / CAST(length(text) AS DOUBLE) < 0.65 THEN 'few_letters' WHEN regexp_matches(text, '\\|') THEN 'structural' WHEN len(regexp_extract_all(text, '[0-9]{4}')) / (length(text) / 1000.0) > 1 THEN 'citations' ELSE 'usable' END"


def reasons(x: Tables):
    long = F.length("text")
    reason = (
        F.when(F.col("n_chars") < 700, "short").when(F.regexp_count("text", F.lit("[A-Za-z]")) / long < 0.65, "few_letters")
        .when(F.col("text").rlike(r"\|"), "structural").when(F.regexp_count("text", F.lit("[0-9]{4}")) / (long / 1000.0) > 1, "citations").otherwise("usable")
    )
    return x.documents.select("doc_id", "source", reason.alias("reason"))


@query(f"SELECT doc_id, {_REASON} AS reason FROM documents")
def usable_page_reason(x: Tables):
    """Why a page is or isn't fit for a sample."""
    return reasons(x).select("doc_id", "reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM documents) GROUP BY reason")
def rejection_histogram(x: Tables):
    """Pages by reason."""
    return reasons(x).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id * 2654435761 % 1000003, doc_id) AS k FROM (SELECT doc_id, source, {_REASON} AS reason FROM documents) WHERE reason = 'usable') WHERE k = 1")
def one_sample_per_source(x: Tables):
    """A seeded draw of one usable page from each source."""
    key = F.struct(F.col("doc_id") * 2654435761 % 1000003, "doc_id")
    return reasons(x).where("reason = 'usable'").groupBy("source").agg(F.min_by("doc_id", key).alias("doc_id"))


@query(f"SELECT doc_id, CAST(greatest(1, min(page) - 2) AS INTEGER) AS first, CAST(least(max(n), max(page) + 2) AS INTEGER) AS last FROM (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS n, line FROM {_LINES}) WHERE regexp_matches(line, 'secret|token|password') GROUP BY doc_id")
def page_windows(x: Tables):
    """The pages that may be read around those that match, two more on each side, within the document."""
    rows = l.lines(x.documents)
    hits = rows.where(F.col("line").rlike("secret|token|password")).groupBy("doc_id").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    n = rows.groupBy("doc_id").agg(F.max("page").alias("n"))
    return hits.join(n, "doc_id").select("doc_id", F.greatest(F.lit(1), F.col("a") - 2).alias("first"), F.least("n", F.col("b") + 2).alias("last"))


@query(f"SELECT doc_id, seq, array_to_string(list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> ''), ' ; ') || '.' AS cells FROM {_LINES} WHERE position('|' IN line) > 0")
def table_rows(x: Tables):
    """Rows of tables in text, as cells parted by semicolons."""
    rows = l.lines(x.documents).where(F.contains("line", F.lit("|")))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.concat(F.array_join(t.cell_values(F.col("line"), r"\|"), " ; "), F.lit(".")).alias("cells"))


_SECTION = f"(SELECT *, sum(CAST(start AS INTEGER)) OVER w AS section, last_value(CASE WHEN start THEN line END IGNORE NULLS) OVER w AS heading FROM (SELECT *, head AND NOT coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY seq), false) AS start FROM (SELECT *, {_HEAD} AS head FROM {_LINES})) WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"


@query(f"SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY seq) AS text, count(*) AS n_lines FROM {_SECTION} GROUP BY doc_id, section")
def section_chunks(x: Tables):
    """One passage for each heading and what stands under it."""
    return l.joined(l.sections(l.lines(x.documents)), "section")


@query(f"SELECT doc_id, page, CASE WHEN position(h IN min(text)) = 0 AND len(string_split(h, ' ')) <= 60 THEN h || chr(10) ELSE '' END || left(min(text), 40) AS head FROM (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY seq) AS text, coalesce(arg_min_null(heading, seq), '') AS h FROM {_SECTION} GROUP BY doc_id, page) WHERE h <> '' GROUP BY doc_id, page, h")
def heading_carry(x: Tables):
    """Pages with the heading they stand under before them, unless they hold it or it is long."""
    rows = l.sections(l.lines(x.documents))
    pages = l.joined(rows, "page").join(rows.groupBy("doc_id", "page").agg(F.min_by("heading", "seq").alias("h")), ["doc_id", "page"]).where("h <> ''")
    before = F.when(~F.contains("text", F.col("h")) & (F.size(F.split("h", " ")) <= 60), F.concat("h", F.lit("\n"))).otherwise("")
    return pages.select("doc_id", "page", F.concat(before, F.substring("text", 1, 40)).alias("head"))


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY doc_id, word")
def word_attestation(x: Tables):
    """How often each document uses a word."""
    words = x.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("SELECT key, CAST(sum(value) AS BIGINT) AS total FROM (SELECT 'docs' AS key, 1 AS value FROM documents UNION ALL SELECT 'chars', n_chars FROM documents UNION ALL SELECT lang, 1 FROM documents) GROUP BY key")
def build_totals(x: Tables):
    """Sums over the documents' maps of statistics."""
    stats = F.map_concat(F.create_map(F.lit("docs"), F.lit(1).cast("long"), F.lit("chars"), "n_chars"), F.create_map("lang", F.lit(1).cast("long")))
    return x.documents.select(F.explode(stats).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


@query("SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(side) AS side, string_agg(left(text, 10), ' ' ORDER BY turn) AS text, count(*) AS n FROM (SELECT *, sum(CAST(coalesce(back <> side, true) AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(side) OVER (PARTITION BY conv_id ORDER BY turn) AS back FROM (SELECT *, turn % 4 < 2 AS side FROM conversations))) GROUP BY conv_id, run")
def merged_runs(x: Tables):
    """Neighbouring turns with the same mark as one."""
    rows = x.conversations.select("conv_id", "turn", (F.col("turn") % 4 < 2).alias("side"), F.substring("text", 1, 10).alias("text"))
    return g.runs(rows, "conv_id", "turn", "side", "text")


@query("SELECT source AS query_id, list_transform(list({'doc': doc_id, 'text_sha': substr(sha256(text), 1, 16)} ORDER BY rank), lambda s: s.doc || ':' || s.text_sha) AS candidates FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3 GROUP BY source")
def candidate_dump(x: Tables):
    """Each query's best rows as one nested row, with their texts' digests; texts are joined after the cut."""
    best = r.top(x.documents.select("source", "doc_id", "n_chars"), "n_chars", "doc_id", 3, ["source"])
    rows = best.join(x.documents.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("sha")), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "sha")))
    return rows.groupBy(F.col("source").alias("query_id")).agg(F.transform(ordered, lambda s: F.concat_ws(":", s["doc_id"], s["sha"])).alias("candidates"))
