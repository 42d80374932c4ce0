"""Queries of lookups, spatial operators and sketches."""

from pyspark.sql import functions as F

from millrace.operators import lookup as lk
from millrace.operators import sketch as sk
from millrace.queries import Registry
from millrace.queries.statistics import rounded

R = Registry()
H = lambda e: f"('0x' || substr(md5({e}), 1, 15))::BIGINT"


@R.add("asof_lookup", "SELECT event_id, (SELECT o_orderkey FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o FROM events e")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "user_id")
    return lk.as_of(t.events.select("event_id", "user_id", "ts"), o, "ts", "o_orderdate", F.col("o_orderkey"), "o_orderkey", ["user_id"], "o").select("event_id", "o")


@R.add("pred_succ", "SELECT p_size, lag(p_size) OVER (ORDER BY p_size) AS predecessor, lead(p_size) OVER (ORDER BY p_size) AS successor FROM (SELECT DISTINCT p_size FROM part)")
def _(t):
    return lk.neighbours(t.part, "p_size")


@R.add("lower_bound", "SELECT w AS wanted, count(*) FILTER (o_totalprice < w) AS lower, count(*) FILTER (o_totalprice <= w) AS upper FROM orders, (VALUES (1000.0::DOUBLE), (100000.0), (250000.0)) v(w) GROUP BY w")
def _(t):
    return lk.bounds(t.orders, "o_totalprice", [1000.0, 100000.0, 250000.0])


@R.add("range_lookup", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
def _(t):
    return lk.range_rows(t.orders, "o_totalprice", 100000.0, 110000.0).select("o_orderkey")


IV = "SELECT p_partkey AS {k}, p_retailprice AS {lo}, p_retailprice + p_size AS {hi} FROM part WHERE p_partkey % 2 = {m}"


@R.add("interval_overlap_join", f"SELECT a, b FROM ({IV.format(k='a', lo='alo', hi='ahi', m=0)}), ({IV.format(k='b', lo='blo', hi='bhi', m=1)}) WHERE alo <= bhi AND blo <= ahi")
def _(t):
    iv = lambda k, lo, hi, m: t.part.where(F.col("p_partkey") % 2 == m).select(F.col("p_partkey").alias(k), F.col("p_retailprice").alias(lo), (F.col("p_retailprice") + F.col("p_size")).alias(hi))
    return lk.overlaps(iv("a", "alo", "ahi", 0), iv("b", "blo", "bhi", 1), "alo", "ahi", "blo", "bhi", 50.0).select("a", "b")


@R.add("interval_stab", "SELECT p_partkey FROM part WHERE p_retailprice <= 1200 AND p_retailprice + p_size >= 1200")
def _(t):
    return lk.stab(t.part.withColumn("hi", F.col("p_retailprice") + F.col("p_size")), "p_retailprice", "hi", 1200.0).select("p_partkey")


@R.add("radius_search", "SELECT a.c_custkey AS a, b.s_suppkey AS b FROM customer a JOIN supplier b ON (a.c_acctbal / 100 - b.s_acctbal / 100) ** 2 + (a.c_nationkey - b.s_nationkey) ** 2 <= 9")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_acctbal") / 100).alias("ax"), F.col("c_nationkey").cast("double").alias("ay"))
    b = t.supplier.select(F.col("s_suppkey").alias("b"), (F.col("s_acctbal") / 100).alias("bx"), F.col("s_nationkey").cast("double").alias("by"))
    return lk.within_radius(a, b, "ax", "ay", "bx", "by", 3.0).select("a", "b")


@R.add("box_search", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 3000 AND c_nationkey BETWEEN 3 AND 9")
def _(t):
    return lk.in_box(t.customer, "c_acctbal", "c_nationkey", (0.0, 3.0, 3000.0, 9.0)).select("c_custkey")


@R.add("closest_pair", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2), 6) AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey ORDER BY sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2), 1, 2 LIMIT 1")
def _(t):
    return rounded(lk.closest_pair(t.part.withColumn("s", F.col("p_size").cast("double")), "p_partkey", "s", "p_retailprice"), distance=6)


KNN = "SELECT q.vec_id AS query, p.vec_id AS point, row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 for x in list_zip(q.embedding, p.embedding)])), p.vec_id) AS nth, p.label FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0"


@R.add("knn_embeddings", f"SELECT query, point, nth FROM ({KNN}) WHERE nth <= 5")
def _(t):
    e = t.embeddings
    return lk.k_nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", "embedding", 5).select("query", "point", "nth")


@R.add("knn_classify", f"SELECT query, label FROM (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, label) r FROM ({KNN}) WHERE nth <= 5 GROUP BY 1, 2) WHERE r = 1")
def _(t):
    e = t.embeddings
    near = lk.k_nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", "embedding", 5)
    votes = near.groupBy("query", "label").count()
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("label"))


@R.add("consistent_hash", f"WITH v AS (SELECT n, {H('n || chr(35) || r')} AS h FROM (VALUES ('a'), ('b'), ('c')) x(n), range(16) y(r)) SELECT c_custkey, coalesce((SELECT n FROM v WHERE h >= {H('c_custkey::VARCHAR')} ORDER BY h LIMIT 1), (SELECT n FROM v ORDER BY h LIMIT 1)) AS node FROM customer")
def _(t):
    return lk.ring_lookup(t.customer, ["a", "b", "c"], sk.portable_hash(F.col("c_custkey"))).select("c_custkey", "node")


@R.add("sorted_set_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) - 1 AS rank FROM customer")
def _(t):
    return lk.rank_in_set(t.customer, "c_acctbal", "c_name", ["c_nationkey"]).select("c_custkey", "rank")


@R.add("range_aggregate", "SELECT i AS range, sum(p_size) AS sum, min(p_size) AS min, max(p_size) AS max FROM part, (VALUES (0, 0, 99), (1, 50, 149), (2, 100, 1999)) v(i, a, b) WHERE p_partkey BETWEEN a AND b GROUP BY i")
def _(t):
    return lk.range_aggregate(t.part, "p_partkey", "p_size", [(0, 99), (50, 149), (100, 1999)])


@R.add("range_update", "SELECT p_partkey, p_retailprice + CASE WHEN p_partkey BETWEEN 10 AND 500 THEN 2.5 ELSE 0 END + CASE WHEN p_partkey BETWEEN 100 AND 900 THEN -1.0 ELSE 0 END AS p_retailprice FROM part")
def _(t):
    return lk.range_update(t.part, "p_partkey", "p_retailprice", [(10, 500, 2.5), (100, 900, -1.0)]).select("p_partkey", "p_retailprice")


@R.add("map_upsert_remove", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 != 0")
def _(t):
    s = t.supplier.select("s_suppkey", "s_acctbal")
    merged = lk.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])
    return lk.remove(merged, s.where("s_suppkey % 5 = 0"), ["s_suppkey"])


POLY = "SELECT p_brand, p_partkey, p_size::DOUBLE x, p_retailprice y FROM part"


@R.add("polygon_area", f"SELECT p_brand, round(sum(x * ny - nx * y) / 2, 2) AS area, round(sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)), 4) AS perimeter FROM (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY p_brand ORDER BY p_partkey)) nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY p_brand ORDER BY p_partkey)) ny FROM ({POLY}) WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) GROUP BY 1")
def _(t):
    p = t.part.withColumn("x", F.col("p_size").cast("double"))
    return rounded(lk.polygon_measures(p, "x", "p_retailprice", ["p_partkey"], ["p_brand"]).select("p_brand", "area", "perimeter"), area=2, perimeter=4)


@R.add("point_in_polygon", "SELECT p_partkey, (p_size > 10 AND p_size < 30 AND p_retailprice > 1000 AND p_retailprice < 1500) AS inside FROM part WHERE p_size NOT IN (10, 30) AND p_retailprice NOT IN (1000, 1500)")
def _(t):
    p = t.part.where("p_size not in (10, 30) and p_retailprice not in (1000, 1500)")
    return lk.in_polygon(p, "p_size", "p_retailprice", [(10.0, 1000.0), (30.0, 1000.0), (30.0, 1500.0), (10.0, 1500.0)]).select("p_partkey", "inside")


@R.add("convex_hull")
def _(t):
    return lk.convex_hull(t.part, "p_size", "p_retailprice", ["p_brand"])


@R.add("approx_distinct")
def _(t):
    return sk.approx_distinct(t.lineitem, "l_partkey", ["l_returnflag"])


@R.add("sketch_merge")
def _(t):
    return sk.merge_sketches(sk.distinct_sketch(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"]), ["l_returnflag"])


@R.add("bloom_semi_join", f"WITH b AS (SELECT DISTINCT {H(chr(39) + chr(39) + ' || c_custkey || chr(58) || i')} % 4000 AS bit FROM customer, range(4) r(i) WHERE c_mktsegment = 'BUILDING') SELECT o_orderkey FROM orders WHERE (SELECT bool_and({H('o_custkey || chr(58) || i')} % 4000 IN (SELECT bit FROM b)) FROM range(4) r(i))")
def _(t):
    bits = sk.bloom_bits(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey"), 4000, 4)
    return sk.bloom_semi_join(t.orders, F.col("o_custkey"), "o_orderkey", bits, 4000, 4).select("o_orderkey")


@R.add("cms_estimate", f"WITH c AS (SELECT i, {H('event_type || chr(58) || i')} % 64 AS slot, count(*) n FROM events, range(4) r(i) GROUP BY 1, 2), q AS (SELECT event_type, i, {H('event_type || chr(58) || i')} % 64 AS slot FROM (SELECT DISTINCT event_type FROM events), range(4) r(i)) SELECT event_type, min(coalesce(n, 0)) AS estimate FROM q LEFT JOIN c USING (i, slot) GROUP BY 1")
def _(t):
    return sk.count_min_estimate(t.events.select("event_type").distinct(), "event_type", sk.count_min(t.events, F.col("event_type"), 64, 4), 64, 4)


TOK = "SELECT DISTINCT l_orderkey AS k, l_partkey AS w FROM lineitem"


def _tokens(t):
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("w")).distinct()


@R.add("minhash_similarity", f"WITH s AS (SELECT k, i, min({H('w || chr(58) || i')}) h FROM ({TOK}), range(16) r(i) GROUP BY 1, 2) SELECT a.k AS a, b.k AS b, count(*) / 16.0::DOUBLE AS similarity FROM s a JOIN s b ON a.i = b.i AND a.h = b.h AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 4")
def _(t):
    return sk.signature_similarity(sk.minhash(_tokens(t), "k", "w", 16), "k", 16, least=0.25)


@R.add("exact_jaccard", f"WITH s AS ({TOK}), n AS (SELECT k, count(*) n FROM s GROUP BY 1), c AS (SELECT a.k a, b.k b, count(*) c FROM s a JOIN s b ON a.w = b.w AND a.k < b.k GROUP BY 1, 2) SELECT a, b, round(c / (x.n + y.n - c), 8) AS jaccard FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 10 * c >= 3 * (x.n + y.n - c)")
def _(t):
    return rounded(sk.exact_jaccard(_tokens(t), "k", "w", least=0.3), jaccard=8)


@R.add("reservoir_sample", f"SELECT o_orderkey FROM orders ORDER BY {H('o_orderkey::VARCHAR')} LIMIT 100")
def _(t):
    return sk.reservoir(t.orders, 100, sk.portable_hash(F.col("o_orderkey"))).select("o_orderkey")


@R.add("weighted_sample", f"SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY ln(({H('o_orderkey::VARCHAR')} + 0.5) / 1152921504606846976.0) / (o_totalprice / 100000) DESC LIMIT 50")
def _(t):
    u = (sk.portable_hash(F.col("o_orderkey")) + F.lit(0.5).cast("double")) / F.lit(1152921504606846976.0)
    return sk.weighted_reservoir(t.orders.withColumn("w", F.col("o_totalprice") / 100000), 50, u, "w").select("o_orderkey")
