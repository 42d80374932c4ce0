"""Queries of hypothesis tests, conjugate posteriors and distributions."""

from pyspark.sql import functions as F

from millrace.functions import distributions as dist
from millrace.operators import hypothesis_tests as ht
from millrace.queries import Registry
from millrace.queries.statistics import rounded

R = Registry()
S = lambda df: rounded(df.select("statistic", "df"), statistic=5, df=4)  # noqa: E731  p-values are held against published values in the tests


@R.add("t_one_sample", "SELECT round((avg(l_quantity) - 25) / sqrt(var_samp(l_quantity) / count(*)), 5) AS statistic, (count(*) - 1)::DOUBLE AS df FROM lineitem")
def _(t):
    return S(ht.t_one_sample(t.lineitem, "l_quantity", 25.0))


MOMENTS = "WITH g AS (SELECT l_returnflag f, count(*) n, avg(l_quantity) m, var_samp(l_quantity) v FROM lineitem GROUP BY 1), p AS (SELECT a.n n1, a.m m1, a.v v1, b.n n2, b.m m2, b.v v2 FROM g a, g b WHERE a.f = 'A' AND b.f = 'R')"


@R.add("t_pooled", MOMENTS + " SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 5) AS statistic, (n1 + n2 - 2)::DOUBLE AS df FROM p")
def _(t):
    return S(ht.t_independent(t.lineitem, "l_quantity", "l_returnflag", "A", "R"))


@R.add("t_welch", MOMENTS + " SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS statistic, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM p")
def _(t):
    return S(ht.t_independent(t.lineitem, "l_quantity", "l_returnflag", "A", "R", equal_var=False))


@R.add("t_paired", "SELECT round(avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)), 5) AS statistic, (count(*) - 1)::DOUBLE AS df FROM lineitem")
def _(t):
    return S(ht.t_paired(t.lineitem, "l_discount", "l_tax"))


@R.add("chi2_fit", "WITH c AS (SELECT o_orderpriority, count(*) o, (SELECT count(*) FROM orders) / 5.0 e FROM orders GROUP BY 1) SELECT round(sum((o - e) ** 2 / e), 5) AS statistic, (count(*) - 1)::DOUBLE AS df FROM c")
def _(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("o"))
    return S(ht.chi2_fit(counts.withColumn("e", F.lit(t.orders.count() / 5)), "o", "e"))


@R.add("anova", "WITH g AS (SELECT c_mktsegment, count(*) n, avg(c_acctbal) m, var_pop(c_acctbal) v FROM customer GROUP BY 1), a AS (SELECT count(*) k, sum(n) n, sum(n * m) / sum(n) mm, sum(n * v) w FROM g), b AS (SELECT sum(g.n * (g.m - a.mm) ** 2) b FROM g, a) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS statistic, (k - 1)::DOUBLE AS df FROM a, b")
def _(t):
    return S(ht.anova(t.customer, "c_acctbal", "c_mktsegment"))


@R.add("ks_one_sample", "WITH e AS (SELECT l_discount x, count(*) c FROM lineitem GROUP BY 1), u AS (SELECT x, c, sum(c) OVER (ORDER BY x) s, sum(c) OVER () n FROM e) SELECT round(max(greatest(abs(s / n - least(greatest(x / 0.1, 0), 1)), abs(least(greatest(x / 0.1, 0), 1) - (s - c) / n))), 5) AS statistic, NULL::DOUBLE AS df FROM u")
def _(t):
    return S(ht.ks_one_sample(t.lineitem, "l_discount", dist.Uniform(0.0, 0.1).cdf_column(F.col("l_discount"))))


@R.add("ks_two_sample", "WITH e AS (SELECT l_extendedprice x, count(*) FILTER (l_returnflag = 'A') a, count(*) FILTER (l_returnflag = 'R') b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), u AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) d FROM e) SELECT round(max(d), 5) AS statistic, NULL::DOUBLE AS df FROM u")
def _(t):
    return S(ht.ks_two_sample(t.lineitem, "l_extendedprice", "l_returnflag", "A", "R"))


@R.add("mann_whitney", "WITH r AS (SELECT c_mktsegment g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 r FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), s AS (SELECT count(*) FILTER (g = 'BUILDING') n1, count(*) FILTER (g = 'MACHINERY') n2, sum(r) FILTER (g = 'BUILDING') r1 FROM r) SELECT round(least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2))::DOUBLE, 5) AS statistic, NULL::DOUBLE AS df FROM s")
def _(t):
    return S(ht.mann_whitney(t.customer, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY"))


@R.add("wilcoxon", "WITH d AS (SELECT round(l_discount - l_tax, 4) d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 r FROM d WHERE d != 0) SELECT round(least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0))::DOUBLE, 5) AS statistic, NULL::DOUBLE AS df FROM r")
def _(t):
    rows = t.lineitem.select(F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("d"), F.lit(0.0).alias("z"))
    return S(ht.wilcoxon(rows, "d", "z"))


@R.add("kruskal_wallis", "WITH r AS (SELECT c_mktsegment g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 r FROM customer), s AS (SELECT g, count(*) n, sum(r) r FROM r GROUP BY 1) SELECT round(greatest(12 / (sum(n)::DOUBLE * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1), 0), 5) AS statistic, (count(*) - 1)::DOUBLE AS df FROM s")
def _(t):
    return S(ht.kruskal(t.customer, "c_acctbal", "c_mktsegment"))


BLOCKS = "SELECT c_nationkey b, c_mktsegment t, round(avg(c_acctbal), 6) x FROM customer GROUP BY 1, 2"


@R.add("friedman", f"WITH x AS ({BLOCKS}), r AS (SELECT b, t, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 r FROM x), s AS (SELECT t, sum(r) r, count(*) n FROM r GROUP BY 1) SELECT round(greatest(12 / (max(n)::DOUBLE * count(*) * (count(*) + 1)) * sum(r * r) - 3 * max(n) * (count(*) + 1), 0), 5) AS statistic, (count(*) - 1)::DOUBLE AS df FROM s")
def _(t):
    x = t.customer.groupBy(F.col("c_nationkey").alias("b"), F.col("c_mktsegment").alias("t")).agg(F.round(F.avg("c_acctbal"), 6).alias("x"))
    return S(ht.friedman(x, "x", "b", "t"))


@R.add("shapiro_wilk")
def _(t):
    return rounded(ht.shapiro_wilk(t.supplier, "s_acctbal"), statistic=6, p_value=6)


@R.add("anderson_darling")
def _(t):
    return rounded(ht.anderson_darling(t.customer, "c_acctbal"), statistic=6, p_value=6)


@R.add("beta_binomial", "SELECT event_type, k, n, 1.0 + k AS alpha, 1.0 + n - k AS beta, round((1.0 + k) / (2.0 + n), 8) AS mean FROM (SELECT event_type, count(*) FILTER (value > 100) k, count(*) n FROM events GROUP BY 1)")
def _(t):
    post = ht.beta_binomial(t.events, F.col("value") > 100, 1.0, 1.0, ("event_type",))
    return rounded(post.drop("variance"), mean=8)


@R.add("gamma_poisson", "SELECT o_orderpriority, 2.0 + sum(n) AS shape, 1.0 + count(*) AS rate, round((2.0 + sum(n)) / (1.0 + count(*)), 8) AS mean FROM (SELECT o_orderpriority, o_custkey, count(*) n FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    per = t.orders.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return rounded(ht.gamma_poisson(per, "n", 2.0, 1.0, ("o_orderpriority",)), mean=8)


@R.add("normal_normal", "SELECT p_brand, count(*) AS n, round((1000.0 / 10000 + sum(p_retailprice) / 250000) / (1.0 / 10000 + count(*) / 250000.0), 5) AS mean, round(1 / (1.0 / 10000 + count(*) / 250000.0), 5) AS variance FROM part GROUP BY 1")
def _(t):
    return rounded(ht.normal_normal(t.part, "p_retailprice", 1000.0, 10000.0, 250000.0, ("p_brand",)), mean=5, variance=5)


@R.add("dist_closed_forms", "SELECT p_partkey, round(1 - exp(-0.1 * p_size), 9) AS exponential, round(1 - exp(-((p_size / 20.0) ** 1.5)), 9) AS weibull, round(1 / (1 + exp(-(p_size - 25) / 5.0)), 9) AS logistic, round(0.5 + atan((p_size - 25) / 10.0) / pi(), 9) AS cauchy, round(exp(-(((p_size - 25) / 10.0) ** 2) / 2) / (10 * sqrt(2 * pi())), 9) AS normal_pdf FROM part")
def _(t):
    x = F.col("p_size").cast("double")
    return t.part.select("p_partkey", F.round(dist.Exponential(0.1).cdf_column(x), 9).alias("exponential"), F.round(dist.weibull_cdf(x, 1.5, 20.0), 9).alias("weibull"), F.round(dist.logistic_cdf(x, 25.0, 5.0), 9).alias("logistic"), F.round(dist.cauchy_cdf(x, 25.0, 10.0), 9).alias("cauchy"), F.round(dist.Normal(25.0, 10.0).pdf_column(x), 9).alias("normal_pdf"))


@R.add("dist_tables")
def _(t):
    x = F.col("p_size").cast("double")
    return t.part.select("p_partkey", *(F.round(d.cdf_column(x / s), 9).alias(n) for n, d, s in (("normal", dist.Normal(25.0, 10.0), 1), ("gamma", dist.Gamma(2.0, 10.0), 1), ("beta", dist.Beta(2.0, 3.0), 50), ("student", dist.StudentT(5.0), 10), ("f", dist.FDist(3.0, 9.0), 10), ("chi2", dist.ChiSquared(20.0), 1), ("binomial", dist.Binomial(50, 0.4), 1), ("poisson", dist.Poisson(20.0), 1), ("geometric", dist.Geometric(0.1), 1))))


E = lambda a, b: f"lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + {a}) + lgamma(n - k + {b}) - lgamma(n + {a} + {b}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"


@R.add("bayes_factor", f"SELECT event_type, round({E('1.0', '1.0')}, 6) AS flat, round(exp(({E('1.0', '1.0')}) - ({E('2.0', '8.0')})), 6) AS factor FROM (SELECT event_type, count(*) FILTER (value > 100)::DOUBLE k, count(*)::DOUBLE n FROM events GROUP BY 1)")
def _(t):
    s = t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count("*").alias("n"))
    flat, other = ht.log_evidence(F.col("k"), F.col("n"), 1.0, 1.0), ht.log_evidence(F.col("k"), F.col("n"), 2.0, 8.0)
    return s.select("event_type", F.round(flat, 6).alias("flat"), F.round(ht.bayes_factor(flat, other), 6).alias("factor"))


@R.add("credible_intervals")
def _(t):
    post = ht.beta_binomial(t.events, F.col("value") > 100, 1.0, 1.0, ("event_type",))
    return post.select("event_type", ht.beta_interval(F.col("alpha"), F.col("beta")).alias("i")).select("event_type", F.round("i.lo", 8).alias("lo"), F.round("i.hi", 8).alias("hi"))
