"""Queries of curation and upkeep: reviews, queues, titles, templates, hashes, tiers, and tests of scores."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioscope.functions import text as t, vectors as v
from folioscope.operators import curation as c, layout as l, ranking as r

from .base import Tables, query
from .texts import _BM25, _ENDS, _LINES, shortlist
from .vectors import _SCORED, scored

_MODES = ("include", "exclude", "only", "tables", "images")


@query("SELECT doc_id, mode, doc_id * 1000 + CASE WHEN mode IN ('only', 'tables', 'images') THEN n_chars // 200 + 1 - n_chars % 3 ELSE 0 END AS first, doc_id * 1000 + n_chars // 200 + 1 - CASE mode WHEN 'exclude' THEN n_chars % 3 ELSE 0 END AS beyond FROM documents, (SELECT unnest(['include', 'exclude', 'only', 'tables', 'images']) AS mode) WHERE n_chars >= 400")
def figure_modes(x: Tables):
    """The range of a document's rows that each figure mode lets be scored; figures are a document's last rows."""
    rows = x.documents.where("n_chars >= 400").select("doc_id", (F.col("doc_id") * 1000).alias("offset"), (F.floor(F.col("n_chars") / 200) + 1).alias("count"), (F.col("n_chars") % 3).alias("figures"))
    each = rows.withColumn("mode", F.explode(F.array(*map(F.lit, _MODES))))
    span = c.figure_range(F.col("mode"), F.col("offset"), F.col("count"), F.col("figures"))
    return each.select("doc_id", "mode", span["first"].alias("first"), span["beyond"].alias("beyond"))


@query(f"SELECT vec_id, own FROM {_SCORED} WHERE own >= 0.35 QUALIFY row_number() OVER (ORDER BY own DESC, vec_id) <= 40")
def score_floor(x: Tables):
    """Rows at or above a floor, before the cut to those shown."""
    return scored(x).where("own >= 0.35").orderBy(F.desc("own"), "vec_id").limit(40).select("vec_id", "own")


@query("SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def shareable_rows(x: Tables):
    """Documents known to be open; those of which nothing is known are refused."""
    return x.documents.join(x.labels.where("toxic = 0").select("doc_id"), "doc_id").select("doc_id", "source")


@query("SELECT page_id, CASE WHEN captions > 0 AND (big > 0 OR share >= 0.15) THEN 'captioned' WHEN big > 0 AND page > 1 THEN 'raster' END AS stratum FROM (SELECT page_id, page_id % 4 + 1 AS page, len(regexp_extract_all(html, '<h[1-6]')) AS captions, len(regexp_extract_all(html, '<(img|a) ')) AS big, len(regexp_extract_all(html, '<p')) / 100.0 AS share FROM pages)")
def figure_strata(x: Tables):
    """The stratum of each page of a census, by captions, large images and drawn share; null where none."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    return x.pages.select("page_id", c.stratum(n("<h[1-6]"), n("<(img|a) "), n("<p") / 100.0, F.col("page_id") % 4 + 1).alias("stratum"))


@query(f"SELECT doc_id, CASE WHEN count(*) FILTER (WHERE NOT thin) = 0 THEN 'full' WHEN count(*) FILTER (WHERE thin AND content) > 0 THEN 'partial' ELSE 'none' END AS need, CASE WHEN count(*) FILTER (WHERE NOT thin) = 0 THEN count(*) ELSE count(*) FILTER (WHERE thin AND content) END AS pages FROM (SELECT doc_id, page, sum(length(trim(line))) < 50 AS thin, bool_or(regexp_matches(line, '[0-9A-Z]')) AS content FROM {_LINES} GROUP BY doc_id, page) GROUP BY doc_id")
def ocr_need(x: Tables):
    """Which documents lack text: on all pages, or on some that hold something else."""
    pages = l.lines(x.documents).groupBy("doc_id", "page").agg((F.sum(F.length(F.trim("line"))) < c.LEAST_PAGE).alias("thin"), F.bool_or(F.col("line").rlike("[0-9A-Z]")).alias("content"))
    return c.ocr_need(pages)


_CELL = "CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'en; xx' WHEN 2 THEN 'en;;fr' WHEN 3 THEN 'fr; fr' ELSE lang END"


@query(f"SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(cell) = '' THEN 'blank' END, CASE WHEN trim(cell) <> '' AND len(list_filter(vals, lambda v: v = '')) > 0 THEN 'empty' END, CASE WHEN len(list_filter(vals, lambda v: v <> '' AND v NOT IN ('en', 'fr', 'de', 'es'))) > 0 THEN 'unknown' END, CASE WHEN trim(cell) <> '' AND len(list_distinct(vals)) <> len(vals) THEN 'repeated' END, CASE WHEN doc_id % 3 = 2 THEN 'confidence' END, CASE WHEN trim(cell) <> lang AND doc_id % 2 = 0 THEN 'note' END], lambda p: p IS NOT NULL), ' ') AS problems FROM (SELECT *, list_transform(string_split(trim(cell), ';'), lambda v: trim(v)) AS vals FROM (SELECT doc_id, lang, {_CELL} AS cell FROM documents))")
def decision_problems(x: Tables):
    """All that is wrong with each row of a review: blank, empty, unknown or repeated values, confidence, a missing note."""
    k = F.col("doc_id")
    cell = F.when(k % 5 == 0, " ").when(k % 5 == 1, "en; xx").when(k % 5 == 2, "en;;fr").when(k % 5 == 3, "fr; fr").otherwise(F.col("lang"))
    sure, note = F.element_at(F.array(*map(F.lit, ("high", "low", "?"))), (k % 3 + 1).cast("int")), F.when(k % 2 == 1, "why").otherwise("")
    return x.documents.select("doc_id", F.array_join(c.problems(cell, ["en", "fr", "de", "es"], sure, note, F.col("lang")), " ").alias("problems"))


@query(f"SELECT doc_id, seq, line FROM {_LINES} JOIN documents USING (doc_id) WHERE contains(source, '1') AND page = 2")
def inspected_passages(x: Tables):
    """The passages on one page of the documents whose name holds a string."""
    named = x.documents.where(F.contains("source", F.lit("1")))
    return l.lines(named).where("page = 2").select("doc_id", F.col("seq").cast("long").alias("seq"), "line")


@query("WITH k AS (SELECT page_id, substr(sha256(url || ':' || html), 1, 16) AS own FROM pages), d AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(sha256(url || ':'), 1, 16) ELSE substr(sha256(url || ':' || html), 1, 16) END AS key, page_id % 5 <> 0 AS is_figure FROM pages) SELECT page_id, key FROM k JOIN d USING (page_id) WHERE is_figure AND key = own")
def vouched_descriptions(x: Tables):
    """Descriptions of figures whose key is still that of the present bytes."""
    key = lambda *parts: F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)
    told = x.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, key("url", F.lit(""))).otherwise(key("url", "html")).alias("key"), (F.col("page_id") % 5 != 0).alias("is_figure"))
    return x.pages.select("page_id", key("url", "html").alias("own")).join(told.where("is_figure"), "page_id").where("key = own").select("page_id", "key")


@query("SELECT source, n_chars % 50 AS page, min(doc_id) AS doc_id, count(*) = 1 AS usable FROM documents GROUP BY source, page")
def page_index_map(x: Tables):
    """The row of each page; a page that several rows cover is not usable."""
    return x.documents.groupBy("source", (F.col("n_chars") % 50).alias("page")).agg(F.min("doc_id").alias("doc_id"), (F.count("*") == 1).alias("usable"))


@query(f"SELECT doc AS label, round(avg(own), 6) AS mean, round(stddev_pop(own), 6) AS spread FROM {_SCORED} GROUP BY doc")
def axis_projection_stats(x: Tables):
    """Mean and spread of the projections on an axis."""
    return scored(x).groupBy(F.col("doc").alias("label")).agg(F.round(F.avg("own"), 6).alias("mean"), F.round(F.stddev_pop("own"), 6).alias("spread"))


_HITS = "len(list_filter(words, lambda w: list_contains([{}], w)))"


@query(f"SELECT doc_id, {_HITS.format(', '.join(map(repr, c.FRENCH)))} >= {_HITS.format(', '.join(map(repr, c.ENGLISH)))} AS french FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ'']+') AS words FROM documents)")
def looks_french(x: Tables):
    """Whether a text has as many French little words as English ones, or more."""
    return x.documents.select("doc_id", c.looks_french(F.col("text")).alias("french"))


_FLOORS = (0.0, 0.25, 0.3, 0.32, 0.35, 0.4, 0.45, 0.5)


@query(f"WITH s AS {_SCORED}, g AS (SELECT doc, max(own) AS top, min(own) AS gold FROM s WHERE vec_id <> 0 GROUP BY doc) SELECT floor, count(*) FILTER (WHERE gold < floor) AS hidden, count(*) FILTER (WHERE top < floor) AS empty FROM g, (SELECT CAST(unnest([{', '.join(map(str, _FLOORS))}]) AS DOUBLE) AS floor) GROUP BY floor")
def floor_table(x: Tables):
    """Right hits that each score floor would hide, and questions that it would leave with nothing."""
    g = scored(x).where("vec_id <> 0").groupBy("doc").agg(F.max("own").alias("top"), F.min("own").alias("gold"))
    each = g.withColumn("floor", F.explode(F.array(*map(F.lit, _FLOORS))))
    return each.groupBy("floor").agg(F.count_if(F.col("gold") < F.col("floor")).alias("hidden"), F.count_if(F.col("top") < F.col("floor")).alias("empty"))


@query(f"WITH s AS {_SCORED}, o AS (SELECT list_sort(list(own)) AS a FROM s) SELECT p, a[least(len(a), CAST(floor(p * len(a)) AS BIGINT) + 1)] AS own FROM o, (SELECT CAST(unnest([0.0, 0.05, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS p)")
def score_percentiles(x: Tables):
    """Scores at fixed places of the sorted order, from counts of each score."""
    counts = scored(x).groupBy("own").agg(F.count("*").alias("n"))
    return c.percentiles(counts, "own", "n", (0.0, 0.05, 0.25, 0.5, 0.75, 1.0))


@query(f"SELECT query_id, lang, round(max(bm25), 6) AS best FROM {_BM25} GROUP BY query_id, lang")
def best_per_language(x: Tables):
    """The best lexical score of each language in each shortlist."""
    s = shortlist(x)
    return r.bm25(s, F.col("question")).join(s.select("query_id", "doc_id", "lang"), ["query_id", "doc_id"]).groupBy("query_id", "lang").agg(F.round(F.max("bm25"), 6).alias("best"))


@query(f"SELECT doc_id, seq, coalesce(lag({_ENDS.replace('{line}', 'line')}) OVER (PARTITION BY doc_id ORDER BY seq), true) AS clean FROM {_LINES}")
def clean_cuts(x: Tables):
    """Whether a passage that begins at a line cuts no sentence: the line before ends one, or there is none."""
    rows = l.lines(x.documents).withColumn("ends", t.ends_sentence(F.col("line")))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.coalesce(F.lag("ends").over(l.in_order()), F.lit(True)).alias("clean"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS fed, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents")
def longest_first(x: Tables):
    """The order in which texts are fed to an encoder, longest first, and the place each result goes back to."""
    by = Window.partitionBy("source")
    return x.documents.select("doc_id", "source", F.row_number().over(by.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("fed"), F.row_number().over(by.orderBy("doc_id")).cast("long").alias("place"))


@query("SELECT d.doc_id, CASE WHEN regexp_matches(source, '1$') THEN 0 WHEN regexp_matches(source, '^src2') THEN 1 WHEN regexp_matches(source, '9') THEN 3 ELSE 2 END AS rank, NOT regexp_matches(source, '1$|^src2|9') AND coalesce(toxic, 0) = 1 AS held FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def queue_ranks(x: Tables):
    """Where documents go in a queue: by the first pattern that the name matches, last ones last, restricted behind their equals."""
    access = x.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank, held = c.queue_rank(F.col("source"), F.coalesce("toxic", F.lit(0)) == 1, ["1$", "^src2"], ["9"])
    return x.documents.join(access, "doc_id", "left").select("doc_id", rank.alias("rank"), held.alias("held"))


@query("SELECT doc_id, start, start + length(word) AS stop, word FROM (SELECT doc_id, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) AS start FROM (SELECT doc_id, unnest(regexp_extract_all(f, '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(f, '[a-z0-9]+'), 1) AS k, unnest(string_split_regex(f, '[a-z0-9]+')[1:len(regexp_extract_all(f, '[a-z0-9]+'))]) AS gap FROM (SELECT doc_id, lower(text) AS f FROM documents WHERE regexp_matches(lower(text), 'secret|token|the')))) WHERE word IN ('secret', 'token', 'the')")
def token_hits(x: Tables):
    """Where terms stand as whole tokens, in characters of the folded text."""
    return c.token_hits(x.documents.select("doc_id", F.lower("text").alias("text")), ["secret", "token", "the"])


_WRAP = r"regexp_replace({}, '(^|[^.!?:;])\n([a-zàâçéèêëîïôûùüÿñæœ(])', '\1 \2', 'g')"
_SOFT = r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '-\n([a-zàâçéèêëîïôûùüÿñæœ])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g')"


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace({_WRAP.format(_WRAP.format(_SOFT))}, '^\\s+', ''), '\\s+$', '')) AS sha FROM documents")
def normalised_texts(x: Tables):
    """Texts without soft hyphens, line-end hyphens and soft line ends, paragraphs kept."""
    return x.documents.select("doc_id", F.sha2(c.normalised(F.col("text")), 256).alias("sha"))


_NAME = "CASE doc_id % 3 WHEN 0 THEN '2024-01-05_' WHEN 1 THEN '-' ELSE '' END || source || '__guide_ ' || doc_id || '.v2.pdf'"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[_-]', ''), '_+', ' ', 'g'), '\\s+', ' ', 'g'), ' -') AS title FROM (SELECT doc_id, {_NAME} AS name FROM documents)")
def clean_titles(x: Tables):
    """Titles from file names: no ending, no leading date, blanks for underscores."""
    k = F.col("doc_id")
    name = F.concat(F.when(k % 3 == 0, "2024-01-05_").when(k % 3 == 1, "-").otherwise(""), F.col("source"), F.lit("__guide_ "), k, F.lit(".v2.pdf"))
    return x.documents.select("doc_id", c.clean_title(name).alias("title"))


@query("SELECT doc_id, CASE WHEN size >= 1000000 THEN printf('%.1f MB', round_even(size / 1000000, 1)) ELSE printf('%.0f kB', round_even(size / 1000, 0)) END AS size FROM (SELECT doc_id, n_chars * 777 AS size FROM documents)")
def human_sizes(x: Tables):
    """Sizes as a reader's browser says them."""
    return x.documents.select("doc_id", c.human_size(F.col("n_chars") * 777).alias("size"))


@query("SELECT doc_id, '<b>' || source || '</b>: ' || replace(replace(replace(replace(replace(left(text, 60), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def filled_templates(x: Tables):
    """A template whose keys are replaced by escaped values."""
    return x.documents.select("doc_id", c.fill("<b>{{source}}</b>: {{head}}", {"source": F.col("source"), "head": F.substring("text", 1, 60)}).alias("html"))


_BEFORE = "sum(length(line)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line)"


@query(f"SELECT doc_id, CASE WHEN length(w) > 120 THEN left(w, 120) || '...' ELSE w END AS evidence FROM (SELECT doc_id, string_agg(rtrim(line), chr(10) ORDER BY seq) AS w FROM (SELECT doc_id, seq, line, {_BEFORE} AS had FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS pages FROM {_LINES}) WHERE page > pages // 2) WHERE had < 120 GROUP BY doc_id)")
def evidence_windows(x: Tables):
    """Some text from the middle of each document on, cut with an ellipsis."""
    rows = l.lines(x.documents).withColumn("pages", F.max("page").over(Window.partitionBy("doc_id"))).where(F.col("page") > F.floor(F.col("pages") / 2))
    return c.window_of(rows, 120)


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN '- ' || source || ' ' || doc_id || ' (' || lang || ', ' || n_chars || '): restricted' ELSE '- [' || source || ' ' || doc_id || '](/doc/' || doc_id || ') (' || lang || ', ' || n_chars || ')' END AS line FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def document_lines(x: Tables):
    """A line for each document: a link, or a note where it is restricted, with facts in brackets."""
    title, facts = F.concat_ws(" ", "source", "doc_id"), F.concat(F.lit(" ("), F.concat_ws(", ", "lang", "n_chars"), F.lit(")"))
    line = F.when(F.col("toxic") == 1, F.concat(F.lit("- "), title, facts, F.lit(": restricted"))).otherwise(F.concat(F.lit("- ["), title, F.lit("](/doc/"), F.col("doc_id"), F.lit(")"), facts))
    return x.documents.join(x.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").select("doc_id", line.alias("line"))


@query("SELECT item_id, to_json({'q': left(text, 40), 'limit': 40, 'tier': CASE WHEN item_id % 2 = 0 THEN 'wide' ELSE 'strict' END}) AS body FROM benchmark")
def request_bodies(x: Tables):
    """A search's request body as JSON."""
    body = F.struct(F.substring("text", 1, 40).alias("q"), F.lit(40).alias("limit"), F.when(F.col("item_id") % 2 == 0, "wide").otherwise("strict").alias("tier"))
    return x.benchmark.select("item_id", F.to_json(body).alias("body"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN own ELSE sha256(own || ':' || n_chars % 3) END AS source_hash FROM (SELECT doc_id, n_chars, sha256('{\"dims\":64}' || chr(0) || '1' || chr(0) || array_to_string(string_split(text, chr(10)), chr(0))) AS own FROM documents)")
def source_hashes(x: Tables):
    """What an encoding was made from: parameters, version and passages, parted by zeros; figures are folded in where there are any."""
    own = c.source_hash('{"dims":64}', "1", F.split("text", "\n"))
    return x.documents.select("doc_id", c.with_payload(own, F.when(F.col("n_chars") % 3 > 0, (F.col("n_chars") % 3).cast("string"))).alias("source_hash"))


@query("SELECT page_id, substr(sha256(sha256(html) || ':en:partial:deskew'), 1, 16) AS digest, page_id % 4 <> 0 AS vouched FROM pages")
def derivative_digests(x: Tables):
    """A derivative's digest from its source's, language, mode and flags; it is vouched for while the source's digest is as recorded."""
    recorded = F.sha2(F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256)
    made = F.substring(F.sha2(F.concat_ws(":", F.sha2("html", 256), F.lit("en"), F.lit("partial"), F.lit("deskew")), 256), 1, 16)
    return x.pages.select("page_id", made.alias("digest"), (recorded == F.sha2("html", 256)).alias("vouched"))


@query()
def batch_plan(x: Tables):
    """Encoder calls for each document's lines, longest first, under a memory budget; a call is priced by its longest row."""
    rows = l.lines(x.documents).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.size(F.split("line", " "))), False).alias("lengths"))
    return rows.select("doc_id", c.plan_batches(F.col("lengths"), budget=6.0, plateau=8).alias("calls"))


@query("""WITH a AS (SELECT CAST(embedding AS DOUBLE[]) AS a, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS size FROM embeddings WHERE vec_id = 1), u AS (SELECT list_transform(a, lambda e: e / size) AS u FROM a),
p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, u, list_dot_product(CAST(embedding AS DOUBLE[]), u) AS d FROM embeddings, u WHERE vec_id <> 1), w AS (SELECT vec_id, u, list_transform(list_zip(e, u), lambda p: p[1] - d * p[2]) AS w FROM p)
SELECT vec_id, 1.0::DOUBLE AS length, round(list_dot_product(w, u), 6) + 0 AS along, round(w[1] / sqrt(list_dot_product(w, w)), 6) AS first FROM w""")
def axis_removed_corpus(x: Tables):
    """All vectors without their part along one axis, made units again."""
    axis = F.broadcast(x.embeddings.where("vec_id = 1").select(v.unit(F.col("embedding")).alias("u")))
    rows = x.embeddings.where("vec_id <> 1").crossJoin(axis).select("vec_id", "u", v.remove_projection(F.col("embedding"), F.col("u")).alias("w"))
    return rows.select("vec_id", F.round(v.dot(F.col("w"), F.col("w")), 6).alias("length"), F.round(v.dot(F.col("w"), F.col("u")), 6).alias("along"), F.round(F.get("w", F.lit(0)), 6).alias("first"))


_TIERS = ("strict", "family", "wide", "no")


@query("WITH d AS (SELECT CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS at FROM documents) SELECT level, CASE WHEN k < 4 THEN (['strict', 'family', 'wide', 'no'])[k + 1] END AS wider, count(*) FILTER (WHERE at <= k) AS shown, count(*) FILTER (WHERE at <= least(4, k + 1)) AS then_shown FROM d, (SELECT unnest(['strict', 'family', 'wide', 'no']) AS level, unnest([1, 2, 3, 4]) AS k) GROUP BY level, k".replace(" AS at ", " AS tier ").replace("WHERE at", "WHERE tier"))
def widen_suggestions(x: Tables):
    """For each level, the next wider one and the documents that either shows."""
    lang = F.col("lang")
    rows = x.documents.select(F.when(lang == "en", 1).when(lang == "fr", 2).when(lang == "de", 3).otherwise(4).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))
    levels = rows.select("tier", "n", F.posexplode(F.array(*map(F.lit, _TIERS))).alias("at", "level"))
    upto = lambda k: F.sum(F.when(F.col("tier") <= k, F.col("n")).otherwise(0))
    counted = levels.groupBy("level", "at").agg(upto(F.col("at") + 1).alias("shown"), upto(F.least(F.lit(len(_TIERS)), F.col("at") + 2)).alias("then_shown"))
    return counted.select("level", F.get(F.array(*map(F.lit, _TIERS)), F.col("at") + 1).alias("wider"), "shown", "then_shown")


@query("WITH f AS (SELECT doc_id, source || '/' || doc_id AS file FROM documents), q AS (SELECT doc_id AS named, CASE doc_id % 4 WHEN 0 THEN source || '/' || doc_id WHEN 1 THEN source || '/' || (doc_id + 20) WHEN 2 THEN 'gone' END AS asked FROM documents) SELECT named, CASE WHEN asked IS NULL THEN named ELSE f.doc_id END AS shown FROM q LEFT JOIN f ON f.file = asked")
def viewer_documents(x: Tables):
    """The document that an address opens: a named file goes before a number, and a number alone is taken."""
    files = x.documents.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("file"))
    k = F.col("doc_id")
    asked = x.documents.select(k.alias("named"), F.when(k % 4 == 0, F.concat_ws("/", "source", "doc_id")).when(k % 4 == 1, F.concat_ws("/", "source", k + 20)).when(k % 4 == 2, "gone").alias("asked"))
    return asked.join(files, asked.asked == files.file, "left").select("named", F.when(F.col("asked").isNull(), F.col("named")).otherwise(F.col("doc_id")).alias("shown"))


_NARROW = "CAST(embedding[1:dims] AS DOUBLE[])"
_SCHEME = f"CASE scheme WHEN 'fp32' THEN {_NARROW} WHEN 'int8' THEN list_transform({_NARROW}, lambda e: greatest(-127, least(127, round_even(e / sqrt(list_dot_product({_NARROW}, {_NARROW})) * 127, 0)))) ELSE list_transform({_NARROW}, lambda e: CASE WHEN e > 0 THEN 1.0 ELSE -1.0 END) END"


@query(f"SELECT dims, scheme, count(*) AS n, round(avg(list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b))), 6) AS likeness FROM (SELECT dims, scheme, CAST({_SCHEME} AS DOUBLE[]) AS a, {_NARROW} AS b FROM embeddings, (SELECT unnest([16, 32, 64]) AS dims), (SELECT unnest(['fp32', 'int8', 'binary']) AS scheme)) GROUP BY dims, scheme")
def width_scheme_sweep(x: Tables):
    """How like the narrowed vectors their stored forms are, for each width and scheme, in one plan."""
    grid = [(d, s) for d in (16, 32, 64) for s in ("fp32", "int8", "binary")]
    one = lambda d, s: F.struct(F.lit(d).alias("dims"), F.lit(s).alias("scheme"), v.dot(v.unit(v.stored(v.narrow(F.col("embedding"), d), s)), v.narrow(F.col("embedding"), d)).alias("likeness"))
    rows = x.embeddings.select(F.explode(F.array(*(one(d, s) for d, s in grid))).alias("g")).select("g.*")
    return rows.groupBy("dims", "scheme").agg(F.count("*").alias("n"), F.round(F.avg("likeness"), 6).alias("likeness"))


@query(f"WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, line AS text FROM {_LINES}), m AS (SELECT doc_id, max(i) AS m FROM p GROUP BY doc_id), f AS (SELECT l.doc_id, m + row_number() OVER (PARTITION BY l.doc_id ORDER BY quality, toxic) AS i, 'figure ' || quality AS text FROM labels l JOIN m USING (doc_id)) SELECT * FROM p UNION ALL SELECT * FROM f")
def figures_last(x: Tables):
    """A document's passages, and its figures' behind them with the numbers that follow."""
    p = l.lines(x.documents).select("doc_id", F.row_number().over(l.in_order()).cast("long").alias("i"), F.col("line").alias("text"))
    last = p.groupBy("doc_id").agg(F.max("i").alias("m"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("quality", "toxic"))
    f = x.labels.join(last, "doc_id").select("doc_id", (F.col("m") + n).alias("i"), F.concat(F.lit("figure "), F.col("quality")).alias("text"))
    return p.unionByName(f)


@query("SELECT source, count(*) FILTER (WHERE l.doc_id IS NULL) AS stale, count(*) AS documents FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source".replace("l.doc_id IS NULL", "l.known IS NULL").replace("SELECT DISTINCT doc_id FROM labels", "SELECT DISTINCT doc_id, true AS known FROM labels"))
def stale_counts(x: Tables):
    """What a build would make anew, without making it."""
    known = x.labels.select("doc_id", F.lit(True).alias("known")).distinct()
    return x.documents.join(known, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("known").isNull()).alias("stale"), F.count("*").alias("documents"))
