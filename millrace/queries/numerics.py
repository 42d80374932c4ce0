"""Queries of linear algebra, signal and numerical operators."""

from pyspark.sql import functions as F

from millrace.operators import linalg as la
from millrace.operators import sequence as seq
from millrace.operators import signal as sg
from millrace.queries import Registry
from millrace.queries.statistics import rounded

R = Registry()
COO = "(SELECT l_orderkey % 40 AS i, l_partkey % 30 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
COB = "(SELECT l_partkey % 30 AS i, l_suppkey % 20 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _a(t):
    return t.lineitem.groupBy((F.col("l_orderkey") % 40).alias("i"), (F.col("l_partkey") % 30).alias("j")).agg(F.sum("l_quantity").alias("v"))


def _b(t):
    return t.lineitem.groupBy((F.col("l_partkey") % 30).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("v"))


@R.add("coo_matmul", f"SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM {COO} a JOIN {COB} b ON a.j = b.i GROUP BY 1, 2")
def _(t):
    return la.matmul(_a(t), _b(t))


@R.add("coo_matvec", f"SELECT a.i AS pos, sum(a.v * (a.j + 1)) AS v FROM {COO} a GROUP BY 1")
def _(t):
    return la.matvec(_a(t), t.spark.range(30).select(F.col("id").alias("pos"), (F.col("id") + 1.0).alias("v")))


@R.add("coo_add", f"SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM {COO} UNION ALL SELECT i, j, -v FROM {COB}) GROUP BY 1, 2")
def _(t):
    return la.add(_a(t), _b(t), 2.0, -1.0)


@R.add("coo_hadamard", f"SELECT a.i AS i, a.j AS j, a.v * b.v AS v FROM {COO} a JOIN {COB} b ON a.i = b.i AND a.j = b.j")
def _(t):
    return la.hadamard(_a(t), _b(t))


@R.add("coo_norms", f"WITH m AS {COO} SELECT (SELECT round(sqrt(sum(v * v)), 6) FROM m) AS frobenius, (SELECT max(abs(v)) FROM m) AS most, (SELECT max(s) FROM (SELECT sum(abs(v)) s FROM m GROUP BY i)) AS inf, (SELECT max(s) FROM (SELECT sum(abs(v)) s FROM m GROUP BY j)) AS one")
def _(t):
    return rounded(la.norms(_a(t)), frobenius=6)


@R.add("coo_trace", f"SELECT sum(v) AS trace FROM {COO} WHERE i = j")
def _(t):
    return la.trace(_a(t))


@R.add("coo_kronecker", f"SELECT a.i * 2 + b.i AS i, a.j * 2 + b.j AS j, a.v * b.v AS v FROM {COO} a, (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 2.0), (1, 1, 3.0)) b(i, j, v)")
def _(t):
    small = t.spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i long, j long, v double")
    return la.kronecker(_a(t), small, 2, 2)


@R.add("vector_blas", "SELECT round(sum(l_quantity * l_extendedprice), 2) AS dot FROM lineitem")
def _(t):
    return rounded(la.dot(t.lineitem, "l_quantity", "l_extendedprice"), dot=2)


@R.add("vector_norms", "SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 4) AS nrm2, round(sum(abs(c_acctbal)), 4) AS asum, max(abs(c_acctbal)) AS amax FROM customer")
def _(t):
    return rounded(la.vector_norms(t.customer, "c_acctbal"), nrm2=4, asum=4)


@R.add("gram_solve", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS c0, round(regr_slope(l_extendedprice, l_quantity), 4) AS c1 FROM lineitem")
def _(t):
    c0, c1 = la.least_squares(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.range(1).select(F.round(F.lit(c0), 3).alias("c0"), F.round(F.lit(c1), 4).alias("c1"))


@R.add("pca_variance", "SELECT round((va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c), 5) AS v1, round((va + vb) / 2 - sqrt(((va - vb) / 2) ** 2 + c * c), 5) AS v2 FROM (SELECT var_samp(l_quantity) va, var_samp(l_discount * 100) vb, covar_samp(l_quantity, l_discount * 100) c FROM lineitem)")
def _(t):
    d = t.lineitem.select("l_quantity", (F.col("l_discount") * 100).alias("d"))
    _, _, (v1, v2) = la.principal_axes(d, ["l_quantity", "d"], 2)
    return t.spark.range(1).select(F.round(F.lit(float(v1)), 5).alias("v1"), F.round(F.lit(float(v2)), 5).alias("v2"))


SER = "(SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_size::DOUBLE AS x FROM part)"


def _series(t):
    return seq.enumerate_rows(t.part.select("p_partkey", F.col("p_size").cast("double").alias("x")), ["p_partkey"]).select("pos", "x")


@R.add("convolve_full", f"SELECT a.pos + b.pos AS pos, sum(a.x * b.x) AS x FROM {SER} a, (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, -1.0)) b(pos, x) GROUP BY 1")
def _(t):
    return sg.convolve(_series(t), t.spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -1.0)], "pos long, x double"))


@R.add("correlate_lags", f"SELECT b.pos - a.pos AS pos, sum(a.x * b.x) AS x FROM {SER} a JOIN {SER} b ON b.pos BETWEEN a.pos AND a.pos + 50 GROUP BY 1")
def _(t):
    s = _series(t)
    return sg.correlate(s, s, 50)


@R.add("fir_filter", "SELECT event_id, round(0.5 * value + 0.3 * coalesce(lag(value) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0), 8) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return rounded(sg.fir(t.events, [0.5, 0.3, 0.2], ["ts", "event_id"], ["user_id"], "value").select("event_id", "y"), y=8)


@R.add("dft_power", f"SELECT k AS bin, round(sum(x * cos(2 * pi() * k * pos / (SELECT count(*) FROM part))) ** 2 + sum(x * sin(2 * pi() * k * pos / (SELECT count(*) FROM part))) ** 2, 3) AS power FROM {SER}, range(0, 33) r(k) GROUP BY k")
def _(t):
    return rounded(sg.dft_power(_series(t), "pos", "x", t.part.count(), 33), power=3)


@R.add("fft_kernels")
def _(t):
    blocks = _series(t).withColumn("block", F.floor(F.col("pos") / 64))
    arr = blocks.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("a"))
    arr = arr.withColumn("a", F.concat("a", F.array_repeat(F.lit(0.0), F.lit(64) - F.size("a"))))  # the last block is filled up
    return arr.select("block", F.transform(sg.ifft(sg.fft(F.col("a"))), lambda v: F.round(v, 6)).alias("back"), F.transform(sg.idct(sg.dct(F.col("a"))), lambda v: F.round(v, 6)).alias("cosine"), F.transform(sg.periodogram(F.col("a")), lambda v: F.round(v, 6)).alias("power"))


@R.add("window_hann", "SELECT n AS pos, round(0.5 - 0.5 * cos(2 * pi() * n / 31), 10) AS w FROM range(32) t(n)")
def _(t):
    return rounded(sg.window_weights(t.spark, "hann", 32), w=10)


@R.add("trapezoid", "SELECT user_id, round(coalesce(sum(a), 0), 4) AS area FROM (SELECT user_id, (event_id - lag(event_id) OVER w) * (value + lag(value) OVER w) / 2 AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def _(t):
    return rounded(sg.trapezoid(t.events, "event_id", "value", ["user_id"]), area=4)


@R.add("simpson", "SELECT user_id, round(CASE WHEN max(n) % 2 = 1 AND max(n) > 2 THEN sum(CASE WHEN r % 2 = 1 THEN a END) END, 4) AS area FROM (SELECT user_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) n, (event_id - lag(event_id, 2) OVER w) / 6.0::DOUBLE * (lag(value, 2) OVER w + 4 * lag(value) OVER w + value) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1")
def _(t):
    return rounded(sg.simpson(t.events, "event_id", "value", ["user_id"]), area=4)


@R.add("gradient", "SELECT event_id, round(coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w), 6) AS gradient FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return rounded(sg.gradient(t.events, "value", 1.0, ["ts", "event_id"], ["user_id"]).select("event_id", "gradient"), gradient=6)


@R.add("interp1d", "WITH s AS (SELECT user_id, event_id x, value y FROM events WHERE event_type IN ('click', 'purchase')), p AS (SELECT user_id, event_id FROM events), b AS (SELECT p.*, (SELECT max(x) FROM s WHERE s.user_id = p.user_id AND x <= p.event_id) x0, (SELECT min(x) FROM s WHERE s.user_id = p.user_id AND x >= p.event_id) x1 FROM p), v AS (SELECT b.*, l.y y0, r.y y1 FROM b LEFT JOIN s l ON l.x = x0 LEFT JOIN s r ON r.x = x1) SELECT event_id, round(coalesce(y0 + (event_id - x0) / nullif(x1 - x0, 0) * (y1 - y0), y0, y1) + 1e-9, 6) AS value FROM v")
def _(t):
    e = t.events.select("user_id", "event_id", "event_type", "value")
    return rounded(sg.interpolate(e.select("user_id", "event_id"), e.where("event_type in ('click', 'purchase')").drop("event_type"), "event_id", "event_id", "value", ["user_id"]).select("event_id", (F.col("value") + 1e-9).alias("value")), value=6)
