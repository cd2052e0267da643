"""Queries over embeddings: quantisation, exact search, blends and evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from folioscope.functions import vectors as v
from folioscope.operators import ranking as r

from .base import Tables, query

E, Q = "embedding", "query"
#: Queries: every fiftieth vector. SQL of both sides: the same.
_QUERIES = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0"
_DOT = "list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def queries(x: Tables, step: int = 50):
    return x.embeddings.where(F.col("vec_id") % step == 0)


def probe(x: Tables):
    """One query vector on each row: that of vec_id 0."""
    return x.embeddings.crossJoin(F.broadcast(x.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))))


_PROBE = "(SELECT vec_id, label, embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"
_COS = "list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"


def rounded(column, digits: int = 6):
    return F.transform(column, lambda x: F.round(x, digits))


@query("SELECT vec_id, round(n[1], 5) AS first, round(list_sum(list_transform(n, lambda x: x * x)), 5) AS length FROM (SELECT vec_id, list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda y: y * y)))) AS n FROM embeddings)")
def embedding_narrow_16(x: Tables):
    """The first 16 components, made a unit."""
    n = v.narrow(F.col(E), 16)
    return x.embeddings.select("vec_id", F.round(F.get(n, F.lit(0)), 5).alias("first"), F.round(v.dot(n, n), 5).alias("length"))


@query("SELECT vec_id, list_transform(embedding, lambda e: CAST(greatest(-127, least(127, round_even(CAST(e AS DOUBLE) * 127, 0))) AS INTEGER)) AS codes FROM embeddings")
def quantise_int8_fixed(x: Tables):
    """Components by a fixed scale, halves to even."""
    return x.embeddings.select("vec_id", v.quantise(F.col(E)).alias("codes"))


@query("SELECT vec_id, list_transform(embedding, lambda e: CAST(greatest(-127, least(127, floor(CAST(e AS DOUBLE) * 127 + 0.5))) AS INTEGER)) AS codes FROM embeddings")
def quantise_query(x: Tables):
    """Each vector's components as a query's, halves up."""
    return x.embeddings.select("vec_id", v.quantise_query(F.col(E)).alias("codes"))


_BACK = "list_transform(list_transform(CAST(embedding AS DOUBLE[]), lambda e: round_even(e / top * {n}, 0) * top / {n}), lambda e: e)"


def _round_trip_sql(n: int) -> str:
    return f"SELECT vec_id, round(list_sum(list_transform(list_zip(back, CAST(embedding AS DOUBLE[])), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(back, lambda e: e * e))), 6) AS likeness FROM (SELECT vec_id, embedding, {_BACK.format(n=n)} AS back FROM (SELECT vec_id, embedding, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda e: abs(e))) AS top FROM embeddings))"


@query(_round_trip_sql(127))
def quantise_int8_per_vector(x: Tables):
    """Likeness of each vector to its own 8-bit round trip."""
    return x.embeddings.select("vec_id", F.round(v.dot(v.round_trip(F.col(E)), F.col(E)), 6).alias("likeness"))


@query(_round_trip_sql(7))
def quantise_int4_per_vector(x: Tables):
    """Likeness of each vector to its own 4-bit round trip."""
    return x.embeddings.select("vec_id", F.round(v.dot(v.round_trip(F.col(E), 7), F.col(E)), 6).alias("likeness"))


@query("SELECT vec_id, CAST(CASE WHEN word >= 9223372036854775808 THEN word - 18446744073709551616 ELSE word END AS BIGINT) AS word FROM (SELECT vec_id, list_reduce(list_transform(embedding, lambda e: CAST(e > 0 AS HUGEINT)), lambda a, b: a * 2 + b) AS word FROM embeddings)")
def binarise_pack_u64(x: Tables):
    """The signs of the 64 components as one number."""
    return x.embeddings.select("vec_id", v.pack(F.col(E)).alias("word"))


@query("SELECT round(sum(-p * log2(p) - (1 - p) * log2(1 - p)), 6) AS bits, count(*) FILTER (WHERE least(p, 1 - p) < 0.1) AS lopsided FROM (SELECT i, greatest(1e-12, least(1 - 1e-12, avg(CAST(e > 0 AS DOUBLE)))) AS p FROM (SELECT unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)")
def bit_balance_entropy(x: Tables):
    """Binary entropy of the signs, summed over dimensions, and dimensions with few of one sign."""
    p = x.embeddings.select(F.posexplode(E).alias("i", "e")).groupBy("i").agg(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.avg((F.col("e") > 0).cast("double")))).alias("p"))
    return p.agg(F.round(F.sum(-F.col("p") * F.log2("p") - (1 - F.col("p")) * F.log2(1 - F.col("p"))), 6).alias("bits"), F.count_if(F.least(F.col("p"), 1 - F.col("p")) < 0.1).alias("lopsided"))


_PAIRS = "SELECT query_id, vec_id, label, qlabel, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS s FROM (SELECT vec_id AS query_id, label AS qlabel, embedding AS q FROM embeddings WHERE vec_id % 50 = 0) CROSS JOIN embeddings"


@query(f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_PAIRS})) WHERE rank <= 10")
def cosine_topk_exact(x: Tables):
    """The ten nearest rows of each query, by matrix products on Arrow batches."""
    return v.best_pairs(x.embeddings, queries(x), 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_ASYM = "list_sum(list_transform(list_zip(embedding, list_transform(q, lambda e: CAST(greatest(-127, least(127, floor(CAST(e AS DOUBLE) * 127 + 0.5))) AS INTEGER))), lambda p: CASE WHEN p[1] > 0 THEN p[2] ELSE -p[2] END)) / (127 * sqrt(64))"


@query(f"SELECT vec_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT vec_id, round({_ASYM}, 6) AS score, row_number() OVER (ORDER BY round({_ASYM}, 6) DESC, vec_id) AS rank FROM {_PROBE}) WHERE rank <= 50")
def asymmetric_binary_topk(x: Tables):
    """Sign vectors against an integer query: the stored side has one bit a component, the query has eight."""
    stored = probe(x).select("vec_id", v.pack(F.col(E)).alias("word"), v.quantise_query(F.col("q")).alias("codes"))
    return r.top(stored.select("vec_id", F.round(v.asymmetric(F.col("word"), F.col("codes"), 64), 6).alias("score")), "score", "vec_id", 50)


@query(f"WITH a AS (SELECT vec_id, embedding, q, round({_ASYM}, 6) AS s FROM {_PROBE}), short AS (SELECT * FROM a ORDER BY s DESC, vec_id LIMIT 100) SELECT vec_id, CAST(row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) AS INTEGER) AS rank, round({_COS}, 6) AS score FROM short QUALIFY row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) <= 20")
def rescore_shortlist(x: Tables):
    """A cheap shortlist scored again at full precision."""
    stored = probe(x).select("vec_id", v.pack(F.col(E)).alias("word"), v.quantise_query(F.col("q")).alias("codes"), "q")
    short = stored.select("vec_id", "q", F.round(v.asymmetric(F.col("word"), F.col("codes"), 64), 6).alias("s")).orderBy(F.desc("s"), "vec_id").limit(100)
    full = short.join(x.embeddings.select("vec_id", E), "vec_id").select("vec_id", F.round(v.dot(F.col(E), F.col("q")), 6).alias("score"))
    return r.top(full, "score", "vec_id", 20)


@query(f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_PAIRS}) WHERE label = qlabel) WHERE rank <= 5")
def within_label_topk(x: Tables):
    """The nearest rows within the query's own label."""
    labelled = x.embeddings.where("label IS NOT NULL")
    return v.best_pairs(labelled, labelled.where("vec_id % 50 = 0"), 5, by="label", own=True).select("query_id", "vec_id", "rank")


@query(f"WITH p AS ({_PAIRS}), top AS (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY max(s) DESC, label) AS k FROM p GROUP BY query_id, label) WHERE k <= 2) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p SEMI JOIN top USING (query_id, label)) WHERE rank <= 5")
def two_stage_topk(x: Tables):
    """The best groups first, then the best rows within them."""
    pairs = v.best_pairs(x.embeddings, queries(x), 5, by="label").withColumn("s", F.round("score", 9)).drop("rank", "score")
    groups = r.top(pairs.groupBy("query_id", "label").agg(F.max("s").alias("s")), "s", "label", 2, ["query_id"]).select("query_id", "label")
    return r.top(pairs.join(groups, ["query_id", "label"], "left_semi"), "s", "vec_id", 5, ["query_id"]).select("query_id", "vec_id", "rank")


_SCORED = f"(SELECT vec_id, label AS doc, vec_id // 10 % 7 AS page, round({_COS}, 9) AS own FROM {_PROBE})"


def scored(x: Tables):
    return probe(x).select("vec_id", F.col("label").alias("doc"), (F.floor(F.col("vec_id") / 10) % 7).alias("page"), F.round(v.dot(F.col(E), F.col("q")), 9).alias("own"))


@query(f"WITH s AS {_SCORED}, p AS (SELECT doc, page, round(avg(own), 9) AS ps FROM s WHERE (doc + page) % 4 <> 0 GROUP BY doc, page) SELECT vec_id, round(0.75 * own + 0.15 * coalesce(p.ps, own) + 0.10 * coalesce(b.ps, own), 6) AS score FROM s LEFT JOIN p ON s.doc = p.doc AND s.page = p.page LEFT JOIN p b ON s.doc = b.doc AND s.page - 1 = b.page")
def context_blend_scores(x: Tables):
    """A row's score blended with its page's and the page before; a missing one counts as the row's own."""
    s = scored(x)
    p = s.where((F.col("doc") + F.col("page")) % 4 != 0).groupBy("doc", "page").agg(F.round(F.avg("own"), 9).alias("ps"))
    back = p.select("doc", (F.col("page") + 1).alias("page"), F.col("ps").alias("bs"))
    joined = s.join(p, ["doc", "page"], "left").join(back, ["doc", "page"], "left")
    return joined.select("vec_id", F.round(r.blend(F.col("own"), F.col("ps"), F.col("bs"), F.lit(None).cast("double"), r.weights(0.15, 0.10)), 6).alias("score"))


@query(f"WITH s AS {_SCORED}, p AS (SELECT doc, page, max(own) AS ps FROM s GROUP BY doc, page) SELECT p.doc, p.page, round(greatest(p.ps, coalesce(b.ps, p.ps)), 6) AS score FROM p LEFT JOIN p b ON p.doc = b.doc AND p.page - 1 = b.page WHERE p.page % 2 = 0")
def maxpool_page_scores(x: Tables):
    """The better of a page and the page before it, which must be exactly one before."""
    p = scored(x).groupBy("doc", "page").agg(F.max("own").alias("ps"))
    back = p.select("doc", (F.col("page") + 1).alias("page"), F.col("ps").alias("bs"))
    return p.join(back, ["doc", "page"], "left").where("page % 2 = 0").select("doc", "page", F.round(F.greatest("ps", F.coalesce("bs", "ps")), 6).alias("score"))


@query(f"WITH s AS {_SCORED} SELECT vec_id, CAST(row_number() OVER (ORDER BY round(own - 0.3 * 0.8 * (vec_id % 256) / 255, 6) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (ORDER BY round(own - 0.3 * 0.8 * (vec_id % 256) / 255, 6) DESC, vec_id) <= 30")
def reference_penalty_rank(x: Tables):
    """Scores less a penalty for likeness to reference lists, before the cut."""
    s = scored(x).select("vec_id", F.round(r.penalty(F.col("own"), F.col("vec_id") % 256, 0.8), 6).alias("score"))
    return r.top(s, "score", "vec_id", 30).select("vec_id", "rank")


@query("SELECT doc_id, round(CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 0.05 * pow(0.5, ((SELECT max(1990 + doc_id % 35) FROM documents WHERE doc_id % 6 <> 0) - (1990 + doc_id % 35)) / 8.0) END, 6) AS bonus FROM documents")
def recency_bonus(x: Tables):
    """Half as much with each eight years of age; none without a year."""
    year = F.when(F.col("doc_id") % 6 == 0, F.lit("n.d.")).otherwise((1990 + F.col("doc_id") % 35).cast("string"))
    return r.recency_bonus(x.documents.select("doc_id", year.alias("year")), "year").select("doc_id", F.round("bonus", 6).alias("bonus"))


@query(f"WITH s AS {_SCORED} SELECT vec_id, CAST(row_number() OVER (ORDER BY round(own + 0.05 * pow(0.5, (2024 - (1990 + vec_id % 35)) / 8.0), 6) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (ORDER BY round(own + 0.05 * pow(0.5, (2024 - (1990 + vec_id % 35)) / 8.0), 6) DESC, vec_id) <= 30")
def recency_rank(x: Tables):
    """Scores with the bonus of recency, before the cut."""
    s = r.recency_bonus(scored(x).withColumn("year", (1990 + F.col("vec_id") % 35).cast("string")), "year")
    return r.top(s.select("vec_id", F.round(F.col("own") + F.col("bonus"), 6).alias("score")), "score", "vec_id", 30).select("vec_id", "rank")


_MEAN = "SELECT i, avg(e) AS m FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {where}) GROUP BY i"


@query(f"SELECT i, round(m / (SELECT sqrt(sum(m * m)) FROM ({_MEAN.format(where='vec_id < 5')})), 6) AS value FROM ({_MEAN.format(where='vec_id < 5')})")
def query_mean_vector(x: Tables):
    """The unit mean of several positive vectors."""
    centre = v.mean(x.embeddings.where("vec_id < 5"), E)
    return centre.select(F.posexplode(v.unit(F.col("centre"))).alias("i", "value")).select((F.col("i") + 1).cast("long").alias("i"), F.round("value", 6).alias("value"))


_AXIS = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)"


@query("WITH a AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS e, CAST(n.embedding AS DOUBLE[]) AS n, CAST(t.embedding AS DOUBLE[]) AS t FROM embeddings e, embeddings n, embeddings t WHERE n.vec_id = 7 AND t.vec_id = 1 AND e.vec_id <> 7), r AS (SELECT vec_id, t, list_transform(list_zip(e, n), lambda p: p[1] - list_dot_product(e, n) / list_dot_product(n, n) * p[2]) AS r FROM a) SELECT vec_id, round(list_dot_product(r, t) / sqrt(list_dot_product(r, r)), 5) AS score FROM r")
def query_projection_removal(x: Tables):
    """Vectors without their part along a negative one, scored against another."""
    one = x.embeddings.where("vec_id = 7").select(v.unit(F.col(E)).alias("axis"))
    other = x.embeddings.where("vec_id = 1").select(F.col(E).alias("to"))
    rows = x.embeddings.where("vec_id <> 7").crossJoin(F.broadcast(one)).crossJoin(F.broadcast(other))
    return rows.select("vec_id", F.round(v.dot(v.remove_projection(F.col(E), F.col("axis")), F.col("to")), 5).alias("score"))


@query(f"WITH c AS (SELECT list(m ORDER BY i) AS c FROM ({_MEAN.format(where='true')})), z AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), c), lambda p: p[1] - p[2]) AS z FROM embeddings, c) SELECT a.vec_id, round(list_dot_product(a.z, b.z) / sqrt(list_dot_product(a.z, a.z) * list_dot_product(b.z, b.z)), 5) AS score FROM z a, z b WHERE b.vec_id = 0")
def centred_cosine(x: Tables):
    """Cosines after the corpus mean is taken off."""
    centre = F.broadcast(v.mean(x.embeddings, E))
    z = x.embeddings.crossJoin(centre).select("vec_id", v.unit(F.zip_with(E, "centre", lambda a, b: a - b)).alias("z"))
    return z.crossJoin(F.broadcast(z.where("vec_id = 0").select(F.col("z").alias("b")))).select("vec_id", F.round(v.dot(F.col("z"), F.col("b")), 5).alias("score"))


@query("SELECT label, count(*) AS n, round(avg(e), 6) AS first FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS e FROM embeddings) GROUP BY label")
def label_centroids(x: Tables):
    """Each label's centroid: its first component, and its rows."""
    return v.mean(x.embeddings, E, "label").join(x.embeddings.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "n", F.round(F.get("centre", F.lit(0)), 6).alias("first"))


@query(f"WITH a AS (SELECT list(m ORDER BY i) AS a FROM ({_MEAN.format(where='vec_id % 5 = 0')})), c AS (SELECT list(m ORDER BY i) AS c FROM ({_MEAN.format(where='true')})), d AS (SELECT list_transform(list_zip(a, c), lambda p: p[1] - p[2]) AS d FROM a, c), s AS (SELECT vec_id, greatest(0, least(1, list_dot_product(CAST(embedding AS DOUBLE[]), d) / sqrt(list_dot_product(d, d)))) AS s FROM embeddings, d) SELECT vec_id, round(s, 6) AS score, round(s / max(s) OVER (), 4) AS share FROM s")
def reference_axis_scores(x: Tables):
    """Likeness to the axis from the corpus to its flagged rows, clipped; and as a share of the largest."""
    flagged = v.mean(x.embeddings.where("vec_id % 5 = 0"), E).withColumnRenamed("centre", "a")
    axis = flagged.crossJoin(v.mean(x.embeddings, E)).select(v.unit(F.zip_with("a", "centre", lambda a, c: a - c)).alias("axis"))
    s = x.embeddings.crossJoin(F.broadcast(axis)).select("vec_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.dot(F.col(E), F.col("axis")))).alias("s"))
    return s.crossJoin(F.broadcast(s.agg(F.max("s").alias("top")))).select("vec_id", F.round("s", 6).alias("score"), F.round(F.col("s") / F.col("top"), 4).alias("share"))


@query("SELECT round(min(c), 5) AS least, round(quantile_cont(c, 0.01), 5) AS p1, round(quantile_cont(c, 0.5), 5) AS median, round(avg(c), 5) AS mean FROM (SELECT list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda e: abs(e))) / 8 AS c FROM embeddings)")
def agreement_stats(x: Tables):
    """How alike vectors and their sign vectors are: least, first percentile, median and mean cosine."""
    c = x.embeddings.select(v.dot(v.signs(F.col(E)), F.col(E)).alias("c"))
    p = c.agg(F.min("c").alias("least"), F.percentile("c", F.array(F.lit(0.01), F.lit(0.5))).alias("p"), F.avg("c").alias("mean"))
    return p.select(F.round("least", 5).alias("least"), F.round(F.get("p", F.lit(0)), 5).alias("p1"), F.round(F.get("p", F.lit(1)), 5).alias("median"), F.round("mean", 5).alias("mean"))


_NARROW_PAIRS = _PAIRS.replace("CAST(embedding AS DOUBLE[])", "CAST(embedding[1:32] AS DOUBLE[])").replace("CAST(q AS DOUBLE[])", "CAST(q[1:32] AS DOUBLE[])")


@query(f"WITH a AS (SELECT query_id, list(vec_id ORDER BY rank) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_PAIRS})) WHERE rank <= 10 GROUP BY query_id), b AS (SELECT query_id, list(vec_id ORDER BY rank) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_NARROW_PAIRS})) WHERE rank <= 10 GROUP BY query_id) SELECT round(avg(CAST(a.v[1] = b.v[1] AS DOUBLE)), 6) AS same_first, round(avg(len(list_intersect(a.v, b.v)) / 10.0), 6) AS overlap FROM a JOIN b USING (query_id)")
def neighbour_churn(x: Tables):
    """How far the ten nearest change when vectors are cut to half their width."""
    def lists(rows):
        best = v.best_pairs(rows, rows.where("vec_id % 50 = 0"), 10)
        return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s["vec_id"]).alias("v"))

    a = lists(x.embeddings)
    b = lists(x.embeddings.select("vec_id", F.slice(E, 1, 32).alias(E))).withColumnRenamed("v", "w")
    return a.join(b, "query_id").agg(F.round(F.avg((F.get("v", F.lit(0)) == F.get("w", F.lit(0))).cast("double")), 6).alias("same_first"), F.round(F.avg(F.size(F.array_intersect("v", "w")) / 10), 6).alias("overlap"))


_RANKS = f"(SELECT query_id, qlabel % 3 AS kind, min(CASE WHEN label = qlabel AND vec_id % 3 = 0 THEN rank END) AS found FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_PAIRS}) WHERE vec_id <> query_id) WHERE rank <= 20 GROUP BY query_id, qlabel)"


def ranks(x: Tables):
    """Each query's first rank with a hit: a row of its label whose id divides by three. Rank 0: none in twenty."""
    best = v.best_pairs(x.embeddings, queries(x), 21).where("query_id <> vec_id")
    best = r.top(best.withColumn("s", F.round("score", 9)).drop("rank"), "s", "vec_id", 20, ["query_id"])
    labels = x.embeddings.select("vec_id", "label")
    rows = best.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    hit = (F.col("label") == F.col("qlabel")) & (F.col("vec_id") % 3 == 0)
    return rows.groupBy("query_id", (F.col("qlabel") % 3).alias("kind")).agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("rank"))


@query(f"SELECT query_id, kind, CAST(coalesce(found, 0) AS INTEGER) AS rank FROM {_RANKS}")
def gold_ranks(x: Tables):
    """The rank of each query's first hit; 0 where there is none."""
    return ranks(x)


def _metrics(group: str) -> str:
    return f"SELECT {group} AS kind, count(*) AS n, round(avg(CAST(coalesce(found, 0) BETWEEN 1 AND 1 AS DOUBLE)), 6) AS at_1, round(avg(CAST(coalesce(found, 0) BETWEEN 1 AND 5 AS DOUBLE)), 6) AS at_5, round(avg(CAST(coalesce(found, 0) BETWEEN 1 AND 10 AS DOUBLE)), 6) AS at_10, round(avg(CASE WHEN found > 0 THEN 1.0 / found ELSE 0 END), 6) AS mrr, round(0.5 / sqrt(count(*)), 6) AS error FROM {_RANKS}"


@query(f"{_metrics(chr(39) + 'all' + chr(39))} UNION ALL {_metrics('CAST(kind AS VARCHAR)')} GROUP BY kind")
def metrics_by_kind(x: Tables):
    """Hit shares, mean reciprocal rank and standard error, over all queries and by kind."""
    at = lambda k: F.round(F.avg(F.col("rank").between(1, k).cast("double")), 6).alias(f"at_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    rows = ranks(x).rollup("kind").agg(F.grouping("kind").alias("all"), F.count("*").alias("n"), at(1), at(5), at(10), mrr, F.round(0.5 / F.sqrt(F.count("*")), 6).alias("error"))
    return rows.withColumn("kind", F.when(F.col("all") == 1, "all").otherwise(F.col("kind").cast("string"))).drop("all")


@query(f"SELECT count(found) AS found, round(avg(CASE WHEN found > 0 THEN 1.0 / found ELSE 0 END), 6) AS mrr FROM {_RANKS}")
def mrr_overall(x: Tables):
    """Mean reciprocal rank, not found counting nothing, and the number found."""
    return ranks(x).agg(F.count_if(F.col("rank") > 0).alias("found"), F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"))


_GRID = "(SELECT p / 10.0 AS page, b / 10.0 AS back FROM range(0, 5) a(p), range(0, 3) c(b))"


@query(f"WITH s AS {_SCORED}, p AS (SELECT doc, page, round(avg(own), 9) AS ps FROM s GROUP BY doc, page), j AS (SELECT s.vec_id, own, p.ps, coalesce(b.ps, own) AS bs FROM s JOIN p ON s.doc = p.doc AND s.page = p.page LEFT JOIN p b ON s.doc = b.doc AND s.page - 1 = b.page) SELECT page, back, vec_id AS best FROM (SELECT g.page, g.back, vec_id, row_number() OVER (PARTITION BY g.page, g.back ORDER BY round((1 - g.page - g.back) * own + g.page * ps + g.back * bs, 6) DESC, vec_id) AS k FROM j, {_GRID} g WHERE vec_id <> 0) WHERE k = 1")
def blend_sweep_grid(x: Tables):
    """The best row under each of fifteen blends, in one plan."""
    s = scored(x)
    p = s.groupBy("doc", "page").agg(F.round(F.avg("own"), 9).alias("ps"))
    back = p.select("doc", (F.col("page") + 1).alias("page"), F.col("ps").alias("bs"))
    j = s.join(p, ["doc", "page"]).join(back, ["doc", "page"], "left").where("vec_id <> 0").select("vec_id", "own", "ps", F.coalesce("bs", "own").alias("bs"))
    grid = F.broadcast(x.spark.createDataFrame([(a / 10, b / 10) for a in range(5) for b in range(3)], "page double, back double"))
    score = F.round((1 - F.col("page") - F.col("back")) * F.col("own") + F.col("page") * F.col("ps") + F.col("back") * F.col("bs"), 6)
    best = j.crossJoin(grid).groupBy("page", "back").agg(F.max_by("vec_id", F.struct(score, -F.col("vec_id"))).alias("best"))
    return best


@query(f"WITH s AS {_SCORED} SELECT half, bonus, vec_id AS best FROM (SELECT h AS half, b / 100.0 AS bonus, vec_id, row_number() OVER (PARTITION BY h, b ORDER BY round(own + b / 100.0 * pow(0.5, (2024 - (1990 + vec_id % 35)) / CAST(h AS DOUBLE)), 6) DESC, vec_id) AS k FROM s, (SELECT unnest([4, 8, 16]) AS h), range(0, 12, 2) c(b) WHERE vec_id <> 0) WHERE k = 1")
def recency_sweep_grid(x: Tables):
    """The best row under each half-life and bonus, in one plan."""
    grid = F.broadcast(x.spark.createDataFrame([(h, b / 100) for h in (4, 8, 16) for b in range(0, 12, 2)], "half int, bonus double"))
    score = F.round(F.col("own") + F.col("bonus") * F.pow(F.lit(0.5), (2024 - (1990 + F.col("vec_id") % 35)) / F.col("half")), 6)
    return scored(x).where("vec_id <> 0").crossJoin(grid).groupBy("half", "bonus").agg(F.max_by("vec_id", F.struct(score, -F.col("vec_id"))).alias("best"))


_CANDIDATES = f"(SELECT vec_id, doc, 'f' || (doc // 3) AS family, doc % 2 = 0 AS collapsible, row_number() OVER (ORDER BY own DESC, vec_id) AS rank, own FROM {_SCORED} QUALIFY row_number() OVER (ORDER BY own DESC, vec_id) <= 300)"


def candidates(x: Tables):
    s = scored(x).withColumn("family", F.concat(F.lit("f"), F.floor(F.col("doc") / 3).cast("string"))).withColumn("collapsible", F.col("doc") % 2 == 0)
    return r.top(s, "own", "vec_id").select("vec_id", F.col("doc").alias("doc_id"), "family", "collapsible", "rank", "own")


@query(f"""
WITH c AS {_CANDIDATES}, w AS (SELECT family, arg_min(doc, rank) AS winner FROM c WHERE collapsible GROUP BY family),
m AS (SELECT c.*, collapsible AND doc <> winner AS lost FROM c LEFT JOIN w USING (family)),
k AS (SELECT *, CASE WHEN NOT lost THEN row_number() OVER (PARTITION BY doc, lost ORDER BY rank) END AS k FROM m),
p AS (SELECT *, sum(CAST(coalesce(k <= 3, false) AS INTEGER)) OVER (ORDER BY rank) AS place FROM k),
z AS (SELECT coalesce(min(rank) FILTER (WHERE k <= 3 AND place = 20), 1000000) AS stop FROM p)
SELECT vec_id, CAST(place AS BIGINT) AS place, CAST(CASE WHEN k = 1 THEN (SELECT count(*) FROM p b, z WHERE b.doc = p.doc AND b.k > 3 AND b.rank < z.stop) ELSE 0 END AS BIGINT) AS more,
  CAST(CASE WHEN collapsible AND rank = (SELECT min(rank) FROM p b WHERE b.family = p.family AND b.collapsible) THEN (SELECT count(DISTINCT b.doc) FROM p b, z WHERE b.family = p.family AND b.lost AND b.rank < z.stop) ELSE 0 END AS INTEGER) AS alternates
FROM p WHERE k <= 3 AND place <= 20""")
def fold_family_and_cap(x: Tables):
    """Candidates folded: redundant documents of a family, three rows of a document, twenty rows in all."""
    return r.fold(candidates(x), shown=20).select("vec_id", "place", F.col("more").cast("long").alias("more"), F.size("alternates").alias("alternates"))


@query(f"SELECT doc AS doc_id, round(max(own), 6) AS score, CAST(min(rank) AS INTEGER) AS rank, count(*) AS n FROM {_CANDIDATES} GROUP BY doc")
def group_by_document(x: Tables):
    """One row for each document of the candidates."""
    rows = candidates(x).withColumn("cosine", F.col("own")).withColumn("score", F.col("own"))
    return r.by_document(rows).select("doc_id", F.round("score", 6).alias("score"), "rank", "n")


@query(f"SELECT query_id, CAST(list_sort(list(DISTINCT y))[len(list(DISTINCT y)) // 2 + 1] AS INTEGER) AS median FROM (SELECT query_id, 1990 + label AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_PAIRS})) WHERE rank <= 8) GROUP BY query_id")
def median_year_topk(x: Tables):
    """The upper median year of the distinct documents among each query's eight best."""
    best = v.best_pairs(x.embeddings, queries(x), 8).join(x.embeddings.select("vec_id", (1990 + F.col("label")).alias("y")), "vec_id")
    years = best.groupBy("query_id").agg(F.sort_array(F.collect_set("y")).alias("ys"))
    return years.select("query_id", F.get("ys", F.floor(F.size("ys") / 2).cast("int")).cast("int").alias("median"))


@query(f"WITH a AS (SELECT query_id, coalesce(found, 0) AS found FROM {_RANKS}) SELECT count(*) FILTER (WHERE d > 0.02) AS wins, count(*) FILTER (WHERE d < -0.02) AS losses, count(*) FILTER (WHERE abs(d) <= 0.02) AS ties FROM (SELECT (CASE WHEN found > 0 THEN 1.0 / found ELSE 0 END) - (query_id // 50 % 5) / 5.0 AS d FROM a)")
def win_loss_deadband(x: Tables):
    """Wins, losses and ties against a baseline, differences within a dead band being ties."""
    base = x.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), (F.floor(F.col("vec_id") / 50) % 5 / 5).alias("base"))
    d = ranks(x).join(base, "query_id").select((F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0) - F.col("base")).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0.02).alias("wins"), F.count_if(F.col("d") < -0.02).alias("losses"), F.count_if(F.abs("d") <= 0.02).alias("ties"))
