"""Queries of the sequence operators."""

from pyspark.sql import functions as F

from millrace.operators import sequence as seq
from millrace.queries import Registry

R = Registry()
EV = ["ts", "event_id"]


@R.add("seq_enumerate", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def _(t):
    return seq.enumerate_rows(t.events.select("event_id", "ts"), EV).select("event_id", "pos")


@R.add("seq_zip", "SELECT c_custkey, p_partkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) r FROM customer) JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) r FROM part) USING (r)")
def _(t):
    return seq.zip_rows(t.customer.select("c_custkey"), t.part.select("p_partkey"), ["c_custkey"], ["p_partkey"]).select("c_custkey", "p_partkey")


@R.add("seq_chain", "SELECT c_nationkey AS k, 0 AS part FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier")
def _(t):
    return seq.chain(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")))


@R.add("seq_map_filter", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000")
def _(t):
    return t.orders.where("o_totalprice > 100000").select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"))


@R.add("seq_take", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def _(t):
    return seq.take(t.orders, 100, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@R.add("seq_skip", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) r FROM orders) WHERE r > 100")
def _(t):
    return seq.skip(t.orders.select("o_orderkey", "o_orderdate"), 100, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


FAILS = "SELECT user_id, event_id, sum(CASE WHEN value < 150 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) f FROM events"


@R.add("seq_take_while", f"SELECT user_id, event_id FROM ({FAILS}) WHERE f = 0")
def _(t):
    return seq.take_while(t.events, F.col("value") < 150, EV, ["user_id"]).select("user_id", "event_id")


@R.add("seq_skip_while", f"SELECT user_id, event_id FROM ({FAILS}) WHERE f > 0")
def _(t):
    return seq.skip_while(t.events, F.col("value") < 150, EV, ["user_id"]).select("user_id", "event_id")


@R.add("seq_partition", "SELECT s_suppkey, s_acctbal > 0 AS side FROM supplier")
def _(t):
    return seq.partition(t.supplier, F.col("s_acctbal") > 0).select("s_suppkey", "side")


@R.add("seq_flat_map", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS item FROM part")
def _(t):
    return seq.flat_map(t.part, F.split("p_name", " ")).select("p_partkey", "item")


@R.add("mapreduce_wordcount", "SELECT key, count(*) AS value FROM (SELECT unnest(string_split(text, ' ')) AS key FROM documents) GROUP BY key")
def _(t):
    return seq.map_reduce(t.documents, F.split("text", " "), F.count("*"))


@R.add("groupby_collect", "SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS items FROM customer GROUP BY c_nationkey")
def _(t):
    return seq.group_values(t.customer, "c_nationkey", "c_custkey")


@R.add("scan_inclusive", "SELECT l_orderkey, sum(q) OVER (ORDER BY l_orderkey) AS scan FROM (SELECT l_orderkey, sum(l_quantity)::BIGINT q FROM lineitem GROUP BY 1)")
def _(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return seq.scan(per, "q", ["l_orderkey"]).select("l_orderkey", "scan")


@R.add("scan_exclusive", "SELECT user_id, event_id, coalesce(sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scan FROM events")
def _(t):
    return seq.scan(t.events.withColumn("v", F.floor("value")), "v", EV, ["user_id"], inclusive=False).select("user_id", "event_id", "scan")


@R.add("scan_segmented", "SELECT event_id, sum(floor(value)::BIGINT) OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS scan FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM events)")
def _(t):
    return seq.segmented_scan(t.events.withColumn("v", F.floor("value")), "v", F.col("event_type") == "purchase", EV, ["user_id"]).select("event_id", "scan")


@R.add("scan_product", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(exp(sum(ln(1 - l_discount)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_tax, l_discount ROWS UNBOUNDED PRECEDING)) + 1e-9, 6) AS product FROM lineitem")
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_tax", "l_discount"]
    rows = seq.running_product(t.lineitem.withColumn("f", 1 - F.col("l_discount")), "f", order, ["l_orderkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.round(F.col("product") + 1e-9, 6).alias("product"))


@R.add("rle_runs", "SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS length FROM (SELECT user_id, event_type, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w = event_type THEN 0 ELSE 1 END c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, run")
def _(t):
    return seq.run_lengths(t.events.select("user_id", "ts", "event_id", "event_type"), "event_type", EV, ["user_id"])


DELTA = "SELECT user_id, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events"


@R.add("delta_encode", DELTA)
def _(t):
    return seq.delta_encode(t.events, "event_id", EV, ["user_id"]).select("user_id", "event_id", "delta")


@R.add("delta_round_trip", "SELECT event_id, event_id AS value FROM events")
def _(t):
    coded = seq.delta_encode(t.events.drop("value"), "event_id", EV, ["user_id"])
    return seq.delta_decode(coded, "delta", EV, ["user_id"]).select("event_id", "value")


@R.add("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) r FROM customer) WHERE r <= 3")
def _(t):
    return seq.top_k(t.customer, 3, [F.col("c_acctbal").desc(), F.col("c_custkey")], ["c_nationkey"]).select("c_nationkey", "c_custkey")


@R.add("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return seq.top_k(t.orders, 10, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@R.add("kth_smallest", "SELECT c_nationkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) r FROM customer) WHERE r = 5")
def _(t):
    return seq.order_statistic(t.customer, "c_acctbal", 4, ["c_nationkey"])


@R.add("upper_median", "SELECT p_brand, list_sort(list(p_size))[count(*) // 2 + 1] AS median FROM part GROUP BY p_brand")
def _(t):
    return seq.upper_median(t.part, "p_size", ["p_brand"])


@R.add("sort_total", "SELECT row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS pos, c_custkey FROM customer")
def _(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", (-F.col("c_acctbal")).alias("down"))
    return seq.enumerate_rows(rows, ["c_mktsegment", "down", "c_custkey"]).select("pos", "c_custkey")


@R.add("longest_consecutive", "SELECT l_suppkey, max(n) AS longest FROM (SELECT l_suppkey, p - r AS g, count(*) n FROM (SELECT l_suppkey, l_partkey p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) r FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return seq.islands(t.lineitem, "l_partkey", ["l_suppkey"]).groupBy("l_suppkey").agg(F.max("length").alias("longest"))


@R.add("max_subarray", "SELECT user_id, round(max(s - least(coalesce(m, 0), 0)), 4) AS max_sum FROM (SELECT user_id, s, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM (SELECT user_id, ts, event_id, sum(value - 100) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM events)) GROUP BY user_id")
def _(t):
    return seq.max_subarray(t.events.withColumn("v", F.col("value") - 100), "v", EV, ["user_id"]).select("user_id", F.round("max_sum", 4).alias("max_sum"))


@R.add("stock_trades", "SELECT user_id, round(max(value - low), 4) AS single, round(sum(greatest(coalesce(rise, 0), 0)), 4) AS unlimited FROM (SELECT user_id, value, min(value) OVER w AS low, value - lag(value) OVER w AS rise FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")
def _(t):
    return seq.best_trade(t.events, "value", EV, ["user_id"]).select("user_id", F.round("single", 4).alias("single"), F.round("unlimited", 4).alias("unlimited"))


@R.add("rain_water", "SELECT user_id, sum(least(l, r) - h) AS water FROM (SELECT user_id, floor(value)::BIGINT h, max(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) l, max(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) r FROM events) GROUP BY user_id")
def _(t):
    return seq.trapped_water(t.events.withColumn("h", F.floor("value")), "h", EV, ["user_id"])
