"""Queries of the statistics operators."""

from pyspark.sql import functions as F

from millrace.operators import sequence as seq
from millrace.operators import statistics as st
from millrace.queries import Registry

R = Registry()
EV = ["ts", "event_id"]


def rounded(df, /, **digits):
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


FLAG = ["l_returnflag", "l_linestatus"]


@R.add("desc_flagship", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(var_samp(l_extendedprice), 2) AS var_samp, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round((avg(l_extendedprice ** 3) - 3 * avg(l_extendedprice) * avg(l_extendedprice ** 2) + 2 * avg(l_extendedprice) ** 3) / stddev_pop(l_extendedprice) ** 3, 6) AS skewness, round(kurtosis_pop(l_extendedprice), 6) AS kurtosis FROM lineitem GROUP BY 1, 2")
def _(t):
    d = st.describe(t.lineitem, "l_extendedprice", FLAG, (0.9,))
    return rounded(d.select(*FLAG, "n", "mean", "median", "var_samp", "q90", "skewness", "kurtosis"), mean=4, median=4, var_samp=2, q90=4, skewness=6, kurtosis=6)


@R.add("desc_spread", "SELECT c_nationkey, round(var_pop(c_acctbal), 3) AS var_pop, round(stddev_samp(c_acctbal), 4) AS std_samp, min(c_acctbal) AS min, max(c_acctbal) AS max, round(quantile_cont(c_acctbal, 0.25), 4) AS q25 FROM customer GROUP BY 1")
def _(t):
    return rounded(st.describe(t.customer, "c_acctbal", ["c_nationkey"]).select("c_nationkey", "var_pop", "std_samp", "min", "max", "q25"), var_pop=3, std_samp=4, q25=4)


@R.add("desc_mode", "SELECT p_brand, p_size AS mode, n FROM (SELECT p_brand, p_size, count(*) n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) r FROM part GROUP BY 1, 2) WHERE r = 1")
def _(t):
    return st.mode(t.part, "p_size", ["p_brand"])


@R.add("hist_1d", "WITH e AS (SELECT min(o_totalprice) lo, (max(o_totalprice) - min(o_totalprice)) / 20 w FROM orders), c AS (SELECT least(floor((o_totalprice - lo) / w)::BIGINT, 19) AS bin, count(*) n FROM orders, e GROUP BY 1) SELECT bin, n FROM c UNION ALL SELECT r, 0 FROM range(20) t(r) WHERE r NOT IN (SELECT bin FROM c)")
def _(t):
    return st.histogram(t.orders, "o_totalprice", 20).select("bin", "n")


@R.add("hist_2d", "WITH e AS (SELECT min(p_size) lx, (max(p_size) - min(p_size)) / 8.0::DOUBLE wx, min(p_retailprice) ly, (max(p_retailprice) - min(p_retailprice)) / 8 wy FROM part) SELECT least(floor((p_size - lx) / wx)::BIGINT, 7) AS xbin, least(floor((p_retailprice - ly) / wy)::BIGINT, 7) AS ybin, count(*) AS n FROM part, e GROUP BY 1, 2")
def _(t):
    return st.histogram2d(t.part, "p_size", "p_retailprice", 8)


@R.add("corr_pearson", "SELECT l_returnflag, l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1, 2")
def _(t):
    return rounded(st.pearson(t.lineitem, "l_quantity", "l_extendedprice", FLAG), r=6)


@R.add("corr_spearman", "WITH a AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 ry FROM part) SELECT round(corr(rx, ry), 6) AS r FROM a")
def _(t):
    return rounded(st.spearman(t.part, "p_size", "p_retailprice"), r=6)


@R.add("corr_kendall", "WITH p AS (SELECT sign(a.s_nationkey - b.s_nationkey) dx, sign(a.s_acctbal - b.s_acctbal) dy FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey), c AS (SELECT count(*) FILTER (dx * dy > 0) concordant, count(*) FILTER (dx * dy < 0) discordant, count(*) FILTER (dx = 0 AND dy != 0) tx, count(*) FILTER (dy = 0 AND dx != 0) ty FROM p) SELECT concordant, discordant, round((concordant - discordant) / sqrt((concordant + discordant + tx)::DOUBLE * (concordant + discordant + ty)), 6) AS tau FROM c")
def _(t):
    return rounded(st.kendall(t.supplier, "s_nationkey", "s_acctbal", "s_suppkey"), tau=6)


@R.add("cov_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem" for a in ("l_quantity", "l_discount", "l_tax") for b in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return rounded(st.covariance_matrix(t.lineitem, ["l_quantity", "l_discount", "l_tax"]), cov=4).withColumn("cov", F.col("cov") + 0.0)


@R.add("ols_by_flag", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 3) AS std_error FROM lineitem GROUP BY 1")
def _(t):
    return rounded(st.ols(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("slope_error"), slope=4, intercept=3, r2=6, std_error=3)


@R.add("ols_residuals", "WITH c AS (SELECT regr_slope(p_retailprice, p_size) s, regr_intercept(p_retailprice, p_size) i FROM part) SELECT p_partkey, round(p_retailprice - (i + s * p_size), 4) AS residual FROM part, c")
def _(t):
    return rounded(st.residuals(t.part, "p_size", "p_retailprice").select("p_partkey", "residual"), residual=4)


@R.add("polyfit_line", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS c0, round(regr_slope(l_extendedprice, l_quantity), 4) AS c1 FROM lineitem")
def _(t):
    c0, c1 = st.polyfit(t.lineitem, "l_quantity", "l_extendedprice", 1)
    return t.spark.range(1).select(F.round(F.lit(c0), 3).alias("c0"), F.round(F.lit(c1), 4).alias("c1"))


@R.add("polyval_horner", "SELECT p_partkey, 1.0::DOUBLE + 2.0 * p_size + 0.5 * p_size * p_size AS y FROM part")
def _(t):
    return t.part.select("p_partkey", st.polyval([1.0, 2.0, 0.5], F.col("p_size").cast("double")).alias("y"))


W = "(PARTITION BY user_id ORDER BY ts, event_id"


@R.add("ts_sma", f"SELECT event_id, CASE WHEN row_number() OVER {W}) >= 5 THEN round(avg(value) OVER {W} ROWS 4 PRECEDING), 6) END AS sma FROM events")
def _(t):
    return rounded(st.moving_average(t.events, "value", 5, EV, ["user_id"]).select("event_id", "sma"), sma=6)


@R.add("ts_wma", f"SELECT event_id, round((lag(value, 2) OVER {W}) + 2 * lag(value) OVER {W}) + 3 * value) / 6, 6) AS wma FROM events")
def _(t):
    return rounded(st.weighted_average(t.events, "value", 3, EV, ["user_id"]).select("event_id", "wma"), wma=6)


@R.add("ts_ema", f"WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER {W}) rn FROM events), e AS (SELECT user_id, event_id, rn, value AS y FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.event_id, s.rn, 0.5::DOUBLE * s.value + 0.5::DOUBLE * e.y FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1) SELECT event_id, round(y + 1e-9, 6) AS ema FROM e")
def _(t):
    return rounded(st.exponential_average(t.events, "value", 3, EV, ["user_id"]).select("event_id", (F.col("ema") + 1e-9).alias("ema")), ema=6)


@R.add("ts_diff", f"SELECT * FROM (SELECT event_id, round(value - lag(value) OVER {W}), 6) AS diff FROM events) WHERE diff IS NOT NULL")
def _(t):
    return rounded(st.difference(t.events, "value", EV, ["user_id"]).select("event_id", "diff"), diff=6)


@R.add("ts_acf", f"WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) d FROM events), l AS (SELECT user_id, d, lead(d, 1) OVER {W}) d1, lead(d, 2) OVER {W}) d2 FROM d), s AS (SELECT user_id, sum(d * d) s0, coalesce(sum(d * d1), 0) s1, coalesce(sum(d * d2), 0) s2 FROM l GROUP BY 1) SELECT user_id, 0 AS lag, CASE WHEN s0 > 0 THEN 1.0::DOUBLE END AS acf FROM s UNION ALL SELECT user_id, 1, CASE WHEN s0 > 0 THEN round(s1 / s0, 6) END FROM s UNION ALL SELECT user_id, 2, CASE WHEN s0 > 0 THEN round(s2 / s0, 6) END FROM s")
def _(t):
    return rounded(st.autocorrelation(t.events, "value", 2, EV, ["user_id"]), acf=6)


DAYS = "SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1"


def _days(t):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total")).withColumn("all", F.lit(1))


@R.add("ts_decompose", f"WITH d AS ({DAYS}), r AS (SELECT day, total, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () n, sum(total) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS m FROM d), q AS (SELECT day, total, pos % 7 ph, CASE WHEN pos >= 3 AND pos < n - 3 THEN m END AS trend FROM r), p AS (SELECT ph, avg(total - trend) raw FROM q GROUP BY ph), s AS (SELECT ph, raw - avg(raw) OVER () AS seasonal FROM p) SELECT day, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal FROM q JOIN s USING (ph)")
def _(t):
    return rounded(st.decompose(_days(t), "total", 7, ["day"], ["all"]).select("day", "trend", "seasonal"), trend=2, seasonal=2)


@R.add("cross_corr", f"WITH d AS ({DAYS}), r AS (SELECT row_number() OVER (ORDER BY day) - 1 AS i, total / 1000000 AS x FROM d) SELECT b.i - a.i AS lag, round(sum(a.x * b.x), 4) AS value FROM r a JOIN r b ON abs(b.i - a.i) <= 10 GROUP BY 1")
def _(t):
    days = seq.enumerate_rows(_days(t).drop("all").withColumn("x", F.col("total") / 1000000), ["day"]).withColumn("y", F.col("x"))
    return rounded(st.cross_correlation(days, "x", "y", "pos", 10), value=4)
