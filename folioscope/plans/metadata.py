"""Queries over document metadata: facets, filters, tiers, gates and derived columns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioscope.functions import text as t
from folioscope.operators import filters

from .base import Tables, query

TIERS = ["strict", "family", "wide"]
#: A label's tier, blank without a label: the SQL of both sides.
TIER = "CASE WHEN quality = 1 AND toxic = 0 THEN 'strict' WHEN quality = 1 THEN 'family' WHEN toxic = 0 THEN 'wide' WHEN toxic = 1 THEN 'no' ELSE '' END"
MARKERS = {"en": r"\b(the|and|of)\b", "fr": r"\b(le|la|les|des)\b", "de": r"\b(der|die|das|und)\b", "es": r"\b(el|los|las|que)\b"}


def docs(x: Tables):
    return x.documents.withColumn("year", F.lit(1990) + F.col("doc_id") % 35)


def tiered(x: Tables):
    return x.documents.select("doc_id", "lang", "source").join(x.labels, "doc_id", "left").withColumn("tier", F.expr(TIER))


@query("SELECT field, value FROM (SELECT DISTINCT 'lang' field, lang AS value FROM documents UNION SELECT DISTINCT 'source', source FROM documents UNION SELECT DISTINCT 'type', p_type FROM part UNION SELECT DISTINCT 'one', 'x') QUALIFY count(*) OVER (PARTITION BY field) > 1")
def facet_options(x: Tables):
    """Distinct values of each field that has more than one."""
    parts = [x.documents.select(F.lit("lang").alias("field"), F.col("lang").alias("value")), x.documents.select(F.lit("source"), "source"), x.part.select(F.lit("type"), "p_type"), x.region.select(F.lit("one"), F.lit("x"))]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()
    return every.join(every.groupBy("field").count().where("count > 1").select("field"), "field", "left_semi")


@query("SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS value FROM part) WHERE value NOT IN ('', '-') GROUP BY value")
def facet_value_counts(x: Tables):
    """Rows by each value of a multi-valued cell, without blanks."""
    return x.part.select(F.explode(t.cell_values(F.col("p_name"), " ")).alias("value")).where("value <> '-'").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'anvil']) AND p_type IN ('ECONOMY', 'PROMO')")
def filter_any_of(x: Tables):
    """Facets: any of a field's values, all fields."""
    test = filters.predicate({"name": ["red", "anvil"], "type": ["ECONOMY", "PROMO"], "brand": []}, {"name": t.cell_values(F.col("p_name"), " "), "type": F.array("p_type"), "brand": F.array("p_brand")})
    return x.part.where(test).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE 1990 + doc_id % 35 >= 2016 UNION ALL SELECT -doc_id - 1 FROM documents WHERE 1990 + doc_id % 35 BETWEEN 1995 AND 1997")
def filter_range_open(x: Tables):
    """Ranges with an open end, and with both."""
    year = F.col("year").cast("string")
    late = docs(x).where(filters.in_range(year, low=2016)).select("doc_id")
    return late.union(docs(x).where(filters.in_range(year, 1995, 1997)).select(-F.col("doc_id") - 1))


@query(f"SELECT doc_id FROM (SELECT d.doc_id, {TIER} AS tier FROM documents d LEFT JOIN labels USING (doc_id)) WHERE tier IN ('strict', 'wide')")
def filter_blank_fails(x: Tables):
    """An active facet on a blank cell fails."""
    return tiered(x).where(filters.predicate({"tier": ["strict", "wide"]}, {"tier": t.cell_values(F.col("tier"))})).select("doc_id")


@query(f"SELECT doc_id, tier FROM (SELECT d.doc_id, {TIER} AS tier FROM documents d LEFT JOIN labels USING (doc_id)) WHERE tier IN ('', 'strict', 'family')")
def tier_nested_blank_passes(x: Tables):
    """Nested tiers: a blank cell passes, an unlisted value fails."""
    return tiered(x).where(filters.within_tier(F.col("tier"), TIERS, "family")).select("doc_id", "tier")


@query(f"SELECT count(*) AS n FROM documents")
def tier_unknown_level(x: Tables):
    """An unknown level filters nothing."""
    return tiered(x).where(filters.within_tier(F.col("tier"), TIERS, "nowhere")).agg(F.count("*").alias("n"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('fr', 'de'))")
def semi_allowed_docs(x: Tables):
    """Vectors of documents that a filter allows."""
    return x.embeddings.select("vec_id").join(x.documents.where(filters.any_of(F.array("lang"), ["fr", "de"])).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing_labels(x: Tables):
    """Documents without a label."""
    return x.documents.select("doc_id", "source").join(x.labels, "doc_id", "left_anti")


@query("SELECT 'document' AS side, doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'vector', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def symmetric_difference_keys(x: Tables):
    """Orphans on either side."""
    d, v = x.documents.select(F.col("doc_id").alias("key")), x.embeddings.select(F.col("vec_id").alias("key"))
    return d.join(v, "key", "left_anti").select(F.lit("document").alias("side"), "key").union(v.join(d, "key", "left_anti").select(F.lit("vector"), "key"))


@query("SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def intersect_keys(x: Tables):
    """Keys on both sides."""
    return x.documents.select("doc_id").intersect(x.embeddings.select("vec_id"))


@query("SELECT key, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, strip_accents(lower(substr(string_split(text, chr(10))[1], 1, 80))) AS key FROM documents) WHERE length(key) > 20 GROUP BY key HAVING count(*) > 1")
def title_key_clashes(x: Tables):
    """Documents whose folded titles are equal."""
    key = t.fold(F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80))
    return x.documents.select("doc_id", key.alias("key")).where(F.length("key") > 20).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_FINGERPRINT = "sha256(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), 1, 4000))"


@query(f"SELECT print, n_lines, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, {_FINGERPRINT} AS print, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents WHERE n_chars >= 200) GROUP BY print, n_lines HAVING count(*) > 1")
def duplicate_documents_fingerprint(x: Tables):
    """Documents with as many lines and the same normalised head."""
    print_ = F.sha2(F.substring(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 1, 4000), 256)
    rows = x.documents.where("n_chars >= 200").select("doc_id", print_.alias("print"), F.size(F.split("text", "\n")).alias("n_lines"))
    return rows.groupBy("print", "n_lines").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT 'type' AS field, value, count(*) AS n FROM (SELECT p_type AS value FROM part) WHERE value NOT IN ('PROMO', 'LARGE', 'SMALL') GROUP BY value UNION ALL SELECT 'name', value, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) WHERE value NOT IN ('red', 'blue', 'green', 'ring', 'anvil', 'widget') GROUP BY value")
def vocabulary_violations(x: Tables):
    """Values outside the closed vocabularies, by field, all at once."""
    closed = x.spark.createDataFrame([("type", v) for v in ("PROMO", "LARGE", "SMALL")] + [("name", v) for v in ("red", "blue", "green", "ring", "anvil", "widget")], "field string, value string")
    values = x.part.select(F.lit("type").alias("field"), F.col("p_type").alias("value")).union(x.part.select(F.lit("name"), F.explode(t.cell_values(F.col("p_name"), " "))))
    return values.groupBy("field", "value").agg(F.count("*").alias("n")).join(closed, ["field", "value"], "left_anti")


@query("SELECT p_partkey, CASE WHEN position('red' IN p_name) > 0 OR p_type = 'PROMO' THEN 'strict' WHEN position('ring' IN p_name) > 0 THEN 'family' WHEN p_type = 'LARGE' THEN 'wide' ELSE '' END AS tier FROM part")
def tier_from_values(x: Tables):
    """The narrowest tier that any value earns, else blank."""
    place = F.create_map(*(F.lit(v) for pair in (("red", 1), ("PROMO", 1), ("ring", 2), ("LARGE", 3)) for v in pair))
    best = F.array_min(F.transform(F.concat(t.cell_values(F.col("p_name"), " "), F.array("p_type")), lambda v: F.try_element_at(place, v)))
    return x.part.select("p_partkey", F.coalesce(F.get(F.array(*map(F.lit, TIERS)), best - 1), F.lit("")).alias("tier"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' WHEN regexp_matches(url, 'blog') THEN 'blog' WHEN regexp_matches(url, '\\.org/') THEN 'org' ELSE '' END AS issuer FROM pages")
def first_match_pattern(x: Tables):
    """The first pattern of an ordered table that matches."""
    return x.pages.select("page_id", t.first_match(F.col("url"), [(r"^https?://m\.", "mobile"), ("blog", "blog"), (r"\.org/", "org")]).alias("issuer"))


_COUNTS = {k: f"len(regexp_extract_all(lower(text), '{p}'))" for k, p in MARKERS.items()}
_MOST = f"greatest({', '.join(_COUNTS.values())})"


@query(
    f"SELECT doc_id, CASE WHEN {' + '.join(_COUNTS.values())} < 10 OR {' + '.join(f'CAST({c} = {_MOST} AS INTEGER)' for c in _COUNTS.values())} > 1 THEN '' "
    + " ".join(f"WHEN {c} = {_MOST} THEN '{k}'" for k, c in _COUNTS.items()) + " END AS language FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS text FROM documents)"
)
def language_marker_guess(x: Tables):
    """The language with most marker words; blank where few, or where two tie."""
    plain = F.regexp_replace("text", "[^A-Za-z]+", " ")
    return x.documents.select("doc_id", t.guess_language(plain, MARKERS).alias("language"))


@query("""
SELECT doc_id, CASE
  WHEN doc_id % 3 = 0 AND 1930 + doc_id % 99 BETWEEN 1940 AND 2024 THEN CAST(1930 + doc_id % 99 AS INTEGER)
  WHEN 1900 + doc_id % 150 BETWEEN 1940 AND 2024 THEN CAST(1900 + doc_id % 150 AS INTEGER) END AS year
FROM documents""")
def year_guess(x: Tables):
    """A plausible year in the name, else in the text, else the fallback; the newest year is a parameter."""
    name = F.concat("source", F.lit(" "), F.when(F.col("doc_id") % 3 == 0, (1930 + F.col("doc_id") % 99).cast("string")).otherwise(""), F.lit(" "))
    return x.documents.select("doc_id", t.guess_year(name, F.lit(""), (1900 + F.col("doc_id") % 150).cast("int"), 2024).alias("year"))


_NINE = "lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"
_SUM10 = " + ".join(f"(10 - {i}) * CAST(substr(d, {i + 1}, 1) AS INTEGER)" for i in range(9))


@query(f"SELECT p_partkey, ({_SUM10} + CASE WHEN substr(d, 10, 1) = 'X' THEN 10 ELSE CAST(substr(d, 10, 1) AS INTEGER) END) % 11 = 0 AS valid FROM (SELECT p_partkey, {_NINE} || CASE WHEN p_partkey % 11 = 10 THEN 'X' ELSE CAST(p_partkey % 11 AS VARCHAR) END AS d FROM part)")
def isbn_checksum(x: Tables):
    """Check digits of ISBN-10."""
    nine = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    last = F.when(F.col("p_partkey") % 11 == 10, F.lit("X")).otherwise((F.col("p_partkey") % 11).cast("string"))
    return x.part.select("p_partkey", t.isbn_valid(F.concat(F.substring(nine, 1, 3), F.lit("-"), F.substring(nine, 4, 6), F.lit("-"), last)).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 IN (1, 2) THEN '10.' || (1000 + doc_id) || '/ab' || doc_id ELSE '' END AS doi FROM documents")
def doi_first_page(x: Tables):
    """The one DOI after a marker on the first two pages; several on a page count as none."""
    one = F.concat(F.lit("See doi:10."), (1000 + F.col("doc_id")).cast("string"), F.lit("/Ab"), F.col("doc_id").cast("string"), F.lit("). "))
    pages = (
        F.when(F.col("doc_id") % 5 == 0, F.array(F.concat(one, F.lit("doi: 10.9999/other")), F.lit("")))
        .when(F.col("doc_id") % 5 == 1, F.array(one, F.lit("x"))).when(F.col("doc_id") % 5 == 2, F.array(F.lit("x"), one)).otherwise(F.array(F.lit("x"), F.lit("y"), one))
    )
    return x.documents.select("doc_id", t.doi_of(pages).alias("doi"))


@query("SELECT page_id, CASE WHEN url_decode(regexp_extract(url, '/([^/?#]*)(?:[?#]|$)', 1)) = '' THEN 'index' ELSE regexp_extract(url, '/([^/?#]*)(?:[?#]|$)', 1) END AS href FROM pages")
def page_href_encode(x: Tables):
    """A link to a page by its name, encoded, blanks as %20."""
    name = F.regexp_extract("url", "/([^/?#]*)(?:[?#]|$)", 1)
    return x.pages.select("page_id", t.href(F.when(name == "", F.lit("index")).otherwise(name)).alias("href"))


@query("SELECT page_id, key, list_sort(list(value)) AS \"values\" FROM (SELECT page_id, regexp_extract(part, '^([^=]*)', 1) AS key, regexp_extract(part, '=(.*)$', 1) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS part FROM pages) WHERE part <> '') GROUP BY page_id, key")
def url_state_filters(x: Tables):
    """Repeated keys of a URL's query as arrays."""
    part = x.pages.select("page_id", F.explode(F.split(F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")), "&")).alias("part")).where("part <> ''")
    pairs = part.select("page_id", F.substring_index("part", "=", 1).alias("key"), F.regexp_extract("part", "=(.*)$", 1).alias("value"))
    return pairs.groupBy("page_id", "key").agg(F.sort_array(F.collect_list("value")).alias("values"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN NULL ELSE CAST(1990 + doc_id % 35 AS INTEGER) END AS low, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE CAST(1995 + doc_id % 35 AS INTEGER) END AS high FROM documents")
def range_parse(x: Tables):
    """Ranges written ``from-to``, either end open."""
    year = F.col("doc_id") % 35
    raw = F.concat(F.when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise((1990 + year).cast("string")), F.lit("-"), F.when(F.col("doc_id") % 3 == 2, F.lit("")).otherwise((1995 + year).cast("string")))
    ends = F.split(raw, "-", 2)
    return x.documents.select("doc_id", F.get(ends, F.lit(0)).try_cast("int").alias("low"), F.get(ends, F.lit(1)).try_cast("int").alias("high"))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL ELSE substr(text, 1, 40) END AS head, n_chars FROM documents")
def strip_restricted_text(x: Tables):
    """Restricted rows keep their facts and lose their text."""
    access = F.when(F.col("lang") == "fr", F.lit("restricted")).otherwise("open")
    return x.documents.withColumn("access", access).select("doc_id", F.when(F.col("access") == "open", F.substring("text", 1, 40)).alias("head"), "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE lang <> 'fr'")
def open_access_rows(x: Tables):
    """Rows of open access; an unknown value would stop the query."""
    return filters.open_rows(x.documents.withColumn("access", F.when(F.col("lang") == "fr", F.lit("restricted")).otherwise("open"))).select("doc_id", "n_chars")


@query("SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id")
def latest_per_key(x: Tables):
    """The last row of each key wins."""
    return x.events.groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("SELECT d.doc_id, CASE WHEN o.print IS NULL THEN 'new' ELSE 'changed' END AS state FROM (SELECT doc_id, sha256(text) AS print FROM documents) d LEFT JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS print FROM documents WHERE doc_id % 5 <> 0) o USING (doc_id) WHERE o.print IS DISTINCT FROM d.print")
def incremental_stale_docs(x: Tables):
    """Documents whose content hash isn't the stored one."""
    now = x.documents.select("doc_id", F.sha2("text", 256).alias("print"))
    stored = x.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("old"))
    return now.join(stored, "doc_id", "left").where(~F.col("print").eqNullSafe(F.col("old"))).select("doc_id", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("state"))


@query("SELECT issuer, n_docs, n_chars FROM (SELECT coalesce(source, '(none)') AS issuer, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source UNION ALL SELECT '(all)', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents)")
def issuer_rollup(x: Tables):
    """Documents and characters by issuer, and over all."""
    rows = x.documents.rollup("source").agg(F.grouping("source").alias("all"), F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return rows.select(F.when(F.col("all") == 1, "(all)").otherwise(F.coalesce("source", F.lit("(none)"))).alias("issuer"), "n_docs", "n_chars").orderBy(F.col("issuer") == "(all)", F.lower("issuer"))


@query(f"SELECT lang, tier, count(*) AS n, count(DISTINCT source) AS n_sources FROM (SELECT lang, source, {TIER} AS tier FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang, tier")
def census_counts(x: Tables):
    """Rows and distinct sources by language and tier."""
    return tiered(x).groupBy("lang", "tier").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


@query("SELECT p_partkey, p_name FROM part WHERE position('rin' IN p_name) > 0 AND position('b' IN p_name) > 0")
def browse_by_name(x: Tables):
    """Rows whose folded names hold all the words asked for, in natural order."""
    return x.part.where(filters.named(F.col("p_name"), "RIN  b")).select("p_partkey", "p_name").orderBy(t.natural_key(F.col("p_name")), "p_partkey")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN 'curated' WHEN doc_id % 4 = 1 THEN '' END, '-'), CASE WHEN doc_id % 4 = 1 THEN NULL END, source) AS issuer FROM documents")
def curated_override(x: Tables):
    """A curated value beats the guess; a curated blank decides that there is none."""
    table = x.documents.where("doc_id % 4 in (0, 1)").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "curated").otherwise("").alias("curated"))
    return x.documents.join(table, "doc_id", "left").select("doc_id", F.coalesce("curated", "source").alias("issuer"))


@query("SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS BIGINT) AS start FROM documents")
def running_offsets(x: Tables):
    """Each document's offset: sums by id block first, so that no window spans the whole table."""
    rows = x.documents.select("doc_id", "n_chars", F.floor(F.col("doc_id") / 4096).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("n_chars").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("n_chars").over(Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(sums.select("block", "base"), "block").select("doc_id", (F.col("base") + within - F.col("n_chars")).alias("start"))
