"""Queries over the star schema: joins, grouping sets, ranking windows and set operations at scale."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .base import Tables, query

_REVENUE = "l_extendedprice * (1 - l_discount)"


@query(f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_REVENUE}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(x: Tables):
    """Sums by flag and status."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = x.lineitem.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(f"SELECT n_name, round(sum({_REVENUE}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def local_supplier_volume(x: Tables):
    """Revenue by nation where customer and supplier share it."""
    rows = x.lineitem.join(x.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(x.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(x.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(F.broadcast(x.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT coalesce(o_orderstatus, '(all)') AS status, coalesce(o_orderpriority, '(all)') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def order_grouping_sets(x: Tables):
    """Orders by status and priority, by status, and over all."""
    rows = x.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("(all)")).alias("status"), F.coalesce("o_orderpriority", F.lit("(all)")).alias("priority"), "n", "total")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_acctbal > 0")
def customers_without_orders(x: Tables):
    """Anti join."""
    return x.customer.where("c_acctbal > 0").join(x.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_orders_per_customer(x: Tables):
    """The two largest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return x.orders.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("o_custkey", "o_orderkey", "rank")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events) WHERE back IS NULL OR ts > back + INTERVAL 6 HOUR GROUP BY user_id")
def user_sessions(x: Tables):
    """Sessions of each user, parted by six idle hours."""
    back = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    starts = x.events.withColumn("back", back).where(F.col("back").isNull() | (F.col("ts") > F.col("back") + F.expr("INTERVAL 6 HOURS")))
    return starts.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT l.event_id, max(c.event_id) AS last_click FROM events l JOIN events c ON c.user_id = l.user_id AND c.event_type = 'click' AND c.ts <= l.ts WHERE l.event_type = 'purchase' GROUP BY l.event_id")
def last_click_before_purchase(x: Tables):
    """As-of join: each purchase with the user's last click, by one sorted pass over each user."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "click").rowsBetween(Window.unboundedPreceding, 0)
    click = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w)
    rows = x.events.where(F.col("event_type").isin("click", "purchase")).withColumn("last_click", click)
    return rows.where("event_type = 'purchase' and last_click is not null").select("event_id", "last_click")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def event_props(x: Tables):
    """A field of JSON by an explicit schema."""
    return x.events.select("event_type", (F.from_json("props", "k int")["k"] % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(left(text, 20), ' / ' ORDER BY turn) AS turns, count(*) AS n, max(turn) + 1 = count(*) AS tiles FROM conversations GROUP BY conv_id")
def conversation_runs(x: Tables):
    """Turns joined in order, and whether they follow each other without a gap."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 20).alias("t"))))
    return x.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda s: s["t"]), " / ").alias("turns"), F.count("*").alias("n"), (F.max("turn") + 1 == F.count("*")).alias("tiles"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_size > 40 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size > 40 AND p_type = 'PROMO'")
def brands_without_large_promos(x: Tables):
    """Difference of sets."""
    large = x.part.where("p_size > 40")
    return large.select("p_brand").distinct().exceptAll(large.where("p_type = 'PROMO'").select("p_brand").distinct())
