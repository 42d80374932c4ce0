"""Queries of machine learning, kernels and streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import kernels as kn
from millrace.operators import learning as ml
from millrace.queries import Registry
from millrace.queries.statistics import rounded
from millrace.streaming import events as ev

R = Registry()
Q = ["q", "p"]


def _points(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("q"), (F.col("p_retailprice") / 50).alias("p"))


CENTRES = [[10.0, 22.0], [25.0, 30.0], [40.0, 38.0]]
D = lambda a, b: f"(p_size - {a}) * (p_size - {a}) + (p_retailprice / 50 - {b}) * (p_retailprice / 50 - {b})"


@R.add("kmeans_assign", f"SELECT p_partkey, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS cluster FROM (SELECT p_partkey, {D(10.0, 22.0)} a, {D(25.0, 30.0)} b, {D(40.0, 38.0)} c FROM part)")
def _(t):
    return ml.assign(_points(t), Q, CENTRES).select("p_partkey", "cluster")


@R.add("kmeans_lloyd")
def _(t):
    centres = ml.kmeans(_points(t), Q, CENTRES, rounds=50)
    return rounded(t.spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "cluster int, q double, p double"), q=4, p=4)


@R.add("dbscan", "WITH RECURSIVE pt AS (SELECT s_suppkey k, s_acctbal / 100 x, s_nationkey::DOUBLE y FROM supplier), nb AS (SELECT a.k a, b.k b FROM pt a JOIN pt b ON a.k != b.k AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 36), core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 2), r(v, c) AS (SELECT a, a FROM core UNION SELECT nb.b, r.c FROM r JOIN nb ON nb.a = r.v WHERE nb.b IN (SELECT a FROM core)), cl AS (SELECT v, min(c) c FROM r GROUP BY 1), nm AS (SELECT c, row_number() OVER (ORDER BY c) - 1 l FROM (SELECT DISTINCT c FROM cl)), lab AS (SELECT v, l FROM cl JOIN nm USING (c)), bd AS (SELECT nb.a v, min(l) l FROM nb JOIN lab ON lab.v = nb.b WHERE nb.a NOT IN (SELECT a FROM core) GROUP BY 1) SELECT k AS s_suppkey, coalesce(lab.l, bd.l, -1) AS label FROM pt LEFT JOIN lab ON lab.v = k LEFT JOIN bd ON bd.v = k")
def _(t):
    s = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return ml.dbscan(s, "s_suppkey", "x", "y", 6.0, 2)


@R.add("bayes_moments", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity, round(var_pop(l_quantity), 5) AS var_l_quantity, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS prior FROM lineitem GROUP BY 1")
def _(t):
    return rounded(ml.class_moments(t.lineitem, ["l_quantity"], "l_returnflag"), mean_l_quantity=6, var_l_quantity=5, prior=8)


@R.add("bayes_predict")
def _(t):
    m = ml.class_moments(t.lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag")
    return ml.naive_bayes(t.lineitem, m, ["l_quantity", "l_extendedprice"], "l_returnflag").groupBy("predicted").agg(F.count("*").alias("n"))


@R.add("regression_scores", "WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i, regr_r2(l_extendedprice, l_quantity) r FROM lineitem) SELECT round(max(r), 6) AS r2, round(avg(abs(l_extendedprice - i - s * l_quantity)), 3) AS mae, round(sqrt(avg((l_extendedprice - i - s * l_quantity) ** 2)), 3) AS rmse FROM lineitem, c")
def _(t):
    model = ml.fit(t.lineitem, "linear", ["l_quantity"], "l_extendedprice", solver="normal")
    return rounded(ml.regression_scores(ml.predict(model, t.lineitem, ["l_quantity"]), "l_extendedprice", "prediction"), r2=6, mae=3, rmse=3)


@R.add("voting", "SELECT p_partkey, CASE WHEN (p_size % 2) + (p_size % 3 > 0)::INT + (p_size > 25)::INT >= 2 THEN 1 ELSE 0 END AS vote FROM part")
def _(t):
    s = F.col("p_size")
    v = t.part.select("p_partkey", (s % 2).alias("a"), (s % 3 > 0).cast("int").alias("b"), (s > 25).cast("int").alias("c"))
    return ml.vote(v, ["a", "b", "c"]).select("p_partkey", "vote")


@R.add("tree_and_forest")
def _(t):
    rows = t.lineitem.withColumn("label", (F.col("l_quantity") * 900 > F.col("l_extendedprice")).cast("double"))
    out = []
    for kind in ("logistic", "tree", "forest", "svm"):
        m = ml.fit(rows, kind, ["l_quantity", "l_extendedprice"], "label")
        out.append((kind, ml.accuracy(ml.predict(m, rows, ["l_quantity", "l_extendedprice"]), "label") > 0.8))
    return t.spark.createDataFrame(out, "model string, good boolean")


@R.add("ada_boost")
def _(t):
    rows = t.part.withColumn("label", (F.col("p_size") > 20).cast("int")).withColumn("s", F.col("p_size").cast("double"))
    model = ml.ada_boost(rows, ["s", "p_retailprice"], "label", 3)
    return rows.select("p_partkey", (ml.boost_margin(model) > 0).alias("predicted"))


@R.add("isolation_forest")
def _(t):
    return ml.isolation_forest(_points(t), Q).select("p_partkey", (F.col("score") > 0.6).alias("odd"))


@R.add("cache_simulation")
def _(t):
    seqs = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("pages"))
    return seqs.select("user_id", *(kn.apply(lambda p, c, policy=policy: kn.cache_hits(p, c, policy), T.LongType(), F.col("pages"), F.lit(2)).alias(policy) for policy in ("lru", "fifo", "lfu")))


@R.add("cache_of_one", "SELECT user_id, count(*) FILTER (event_type = before) AS hits FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def _(t):
    seqs = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"]).alias("pages"))
    return seqs.select("user_id", kn.apply(lambda p: kn.cache_hits(p, 1), T.LongType(), F.col("pages")).alias("hits"))


@R.add("dp_kernels")
def _(t):
    a = t.part.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda e: e["p_size"]).alias("a"))
    return a.select("p_brand", *(kn.apply(f, T.LongType(), F.col("a")).alias(n) for n, f in (("lis", kn.lis), ("bitonic", kn.bitonic), ("robber", lambda v: int(kn.house_robber(v))), ("ways", lambda v: kn.coin_ways([int(x) for x in v], 60)), ("bins", lambda v: kn.first_fit_decreasing(v, 60)), ("knapsack", lambda v: int(kn.knapsack([int(x) for x in v], [int(x) for x in v], 100))))))


@R.add("dp_house_robber_pairs", "SELECT o_custkey, greatest(a, b) AS best FROM (SELECT o_custkey, floor(max(o_totalprice))::BIGINT a, floor(min(o_totalprice))::BIGINT b FROM orders GROUP BY 1)")
def _(t):
    two = t.orders.groupBy("o_custkey").agg(F.array(F.floor(F.max("o_totalprice")), F.floor(F.min("o_totalprice"))).alias("a"))
    return two.select("o_custkey", kn.apply(lambda v: int(kn.house_robber(v)), T.LongType(), F.col("a")).alias("best"))


@R.add("session_windows", "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)) GROUP BY user_id, s")
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e, "ts", "1 day", ["user_id"], [F.count("*").alias("n")]).select("user_id", "n")


@R.add("tumbling_windows", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, date_trunc('day', ts)")
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(ev.windowed(e, "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")]).select("event_type", "n", "total"), total=4)
