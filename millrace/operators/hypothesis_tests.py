"""Hypothesis tests: aggregates in Spark, p-values from the distributions on one row per test.

Every test gives statistic, p_value and df (null where there is none); a test rejects if p_value < alpha.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import distributions as dist
from millrace.functions import special
from millrace.operators.sequence import scan
from millrace.operators.statistics import average_rank

_NORMAL = dist.Normal()


def _result(spark, statistic: float, p: float, df: float | None) -> DataFrame:
    return spark.createDataFrame([(float(statistic), float(min(max(p, 0.0), 1.0)), None if df is None else float(df))], "statistic double, p_value double, df double")


def _two_sided_t(t: float, df: float) -> float:
    return 2 * (1 - float(dist.StudentT(df).cdf(np.array([abs(t)]))[0]))


def _upper(d, x: float) -> float:
    return 1 - float(np.atleast_1d(d.cdf(np.array([x])))[0])


def _normal_two_sided(z: float) -> float:
    return 2 * (1 - float(_NORMAL.cdf(np.array([abs(z)]))[0]))


def t_one_sample(df: DataFrame, x: str, mean: float) -> DataFrame:
    n, m, v = df.agg(F.count(x), F.avg(x), F.var_samp(x)).first()
    if n < 2:
        raise ValueError("two values at least")
    se = math.sqrt(v / n)
    t = (m - mean) / se if se else 0.0
    return _result(df.sparkSession, t, _two_sided_t(t, n - 1) if se else 1.0, n - 1)


def t_independent(df: DataFrame, x: str, group: str, a, b, equal_var: bool = True) -> DataFrame:
    """Pooled, or Welch's with Satterthwaite's degrees of freedom."""
    rows = {r[0]: r[1:] for r in df.where(F.col(group).isin(a, b)).groupBy(group).agg(F.count(x), F.avg(x), F.var_samp(x)).collect()}  # two rows
    (n1, m1, v1), (n2, m2, v2) = rows[a], rows[b]
    if equal_var:
        dof = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2))
    else:
        q1, q2 = v1 / n1, v2 / n2
        se = math.sqrt(q1 + q2)
        dof = (q1 + q2) ** 2 / (q1**2 / (n1 - 1) + q2**2 / (n2 - 1)) if se else n1 + n2 - 2
    t = (m1 - m2) / se if se else 0.0
    return _result(df.sparkSession, t, _two_sided_t(t, dof) if se else 1.0, dof)


def t_paired(df: DataFrame, before: str, after: str) -> DataFrame:
    return t_one_sample(df.select((F.col(before) - F.col(after)).alias("d")), "d", 0.0)


def chi2_fit(df: DataFrame, observed: str, expected: str) -> DataFrame:
    n, s, bad = df.agg(F.count("*"), F.sum(F.pow(F.col(observed) - F.col(expected), 2) / F.col(expected)), F.count_if((F.col(expected) <= 0) | (F.col(observed) < 0))).first()
    if bad or n < 2:
        raise ValueError("expected counts must be positive, observed ones not negative")
    return _result(df.sparkSession, s, _upper(dist.ChiSquared(n - 1), s), n - 1)


def anova(df: DataFrame, x: str, group: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    k, n, total, within = g.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("v"))).first()
    between = g.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.lit(total / n), 2))).first()[0]
    f = (between / (k - 1)) / (within / (n - k)) if within else 0.0
    return _result(df.sparkSession, f, _upper(dist.FDist(k - 1, n - k), f) if within else 1.0, k - 1)


def _ecdf(df: DataFrame, x: str) -> DataFrame:
    """Distinct values with the counts at and up to each, by a two-phase running sum."""
    return scan(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("c")), "c", [x], out="upto")


def ks_one_sample(df: DataFrame, x: str, cdf: Column) -> DataFrame:
    """``cdf`` is the distribution function as an expression of the column ``x``."""
    e = _ecdf(df, x)
    n = df.where(F.col(x).isNotNull()).count()
    d = e.withColumn("f", cdf).agg(F.max(F.greatest(F.abs(F.col("upto") / n - F.col("f")), F.abs(F.col("f") - (F.col("upto") - F.col("c")) / n)))).first()[0]
    return _result(df.sparkSession, d, 2 * math.exp(-2 * n * d * d), None)


def ks_two_sample(df: DataFrame, x: str, group: str, a, b, method: str = "root") -> DataFrame:
    """The p-value's exponent takes the root of n1 n2 / (n1 + n2); "asymptotic" takes it without."""
    rows = df.where(F.col(group).isin(a, b) & F.col(x).isNotNull())
    counts = rows.groupBy(x).agg(F.count_if(F.col(group) == a).alias("ca"), F.count_if(F.col(group) == b).alias("cb"))
    n1, n2 = counts.agg(F.sum("ca"), F.sum("cb")).first()
    both = scan(scan(counts, "ca", [x], out="sa"), "cb", [x], out="sb")
    d = both.select(F.abs(F.col("sa") / n1 - F.col("sb") / n2).alias("d")).agg(F.max("d")).first()[0]
    size = n1 * n2 / (n1 + n2)
    return _result(df.sparkSession, d, 2 * math.exp(-2 * d * d * (math.sqrt(size) if method == "root" else size)), None)


def mann_whitney(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """Normal approximation, without corrections for ties or continuity."""
    ranked = average_rank(df.where(F.col(group).isin(a, b)).select(group, x), x)
    n1, n2, r1 = ranked.agg(F.count_if(F.col(group) == a), F.count_if(F.col(group) == b), F.sum(F.when(F.col(group) == a, F.col("rank")))).first()
    u1 = r1 - n1 * (n1 + 1) / 2
    u = min(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return _result(df.sparkSession, u, _normal_two_sided(z), None)


def wilcoxon(df: DataFrame, before: str, after: str) -> DataFrame:
    """Signed ranks; zero differences are dropped."""
    d = df.select((F.col(before) - F.col(after)).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    n, up, down = average_rank(d, "size").agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0))).first()
    w = min(up, down)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return _result(df.sparkSession, w, _normal_two_sided((w - n * (n + 1) / 4) / sd) if sd else 1.0, None)


def kruskal(df: DataFrame, x: str, group: str) -> DataFrame:
    g = average_rank(df.select(group, x), x).groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    k, n, s = g.agg(F.count("*"), F.sum("n"), F.sum(F.col("r") * F.col("r") / F.col("n"))).first()
    h = max(12 / (n * (n + 1)) * s - 3 * (n + 1), 0.0)
    return _result(df.sparkSession, h, _upper(dist.ChiSquared(k - 1), h), k - 1)


def friedman(df: DataFrame, x: str, block: str, treatment: str) -> DataFrame:
    ranked = average_rank(df.select(block, treatment, x), x, [block])
    sums = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    k, n, s = sums.agg(F.count("*"), F.max("n"), F.sum(F.col("r") * F.col("r"))).first()
    q = max(12 / (n * k * (k + 1)) * s - 3 * n * (k + 1), 0.0)
    return _result(df.sparkSession, q, _upper(dist.ChiSquared(k - 1), q), k - 1)


#: Ranks of one value that are taken together.
RUN = 256


def _scores(n: int):
    """For batches of (x, c, at): x times the sum of the normal scores of the c ranks after ``at``, of n."""

    def run(batches):
        for pdf in batches:
            c = pdf["c"].to_numpy()
            ends = np.cumsum(c)
            rank = np.arange(1, c.sum() + 1) + np.repeat(pdf["at"].to_numpy() - ends + c, c)
            z = _NORMAL.quantile((rank - 0.375) / (n + 0.25))
            total = np.concatenate([[0.0], np.cumsum(z)])
            yield pd.DataFrame({"s": [float(pdf["x"].to_numpy() @ (total[ends] - total[ends - c]))]})

    return run


def shapiro_wilk(df: DataFrame, x: str) -> DataFrame:
    """The simplified statistic W = (sum z x)^2 / (n SS) with normal scores. Ranks come from counts of distinct values, those of a hot value in runs."""
    v = F.col(x).cast("double")
    n, mean, var, lo, hi = df.agg(F.count(v), F.avg(v), F.var_pop(v), F.min(v), F.max(v)).first()
    if n < 3:
        raise ValueError("three values at least")
    if lo == hi:
        return _result(df.sparkSession, 1.0, 1.0, None)
    first = F.col("upto") - F.col("c")
    runs = _ecdf(df.select(v.alias("x")), "x").withColumn("at", F.explode(F.sequence(first, F.col("upto") - 1, F.lit(RUN))))
    runs = runs.select((F.col("x") - mean).alias("x"), F.least(F.lit(RUN), F.col("upto") - F.col("at")).alias("c"), "at")
    zx = runs.mapInPandas(_scores(n), "s double").agg(F.sum("s")).first()[0]
    w = min(max(zx**2 / (n * n * var), 0.0), 1.0)
    return _result(df.sparkSession, w, _normal_two_sided((1 - w) * math.sqrt(n)), None)


def anderson_darling(df: DataFrame, x: str) -> DataFrame:
    """Against a normal of the sample's mean and population deviation; the p-value by the usual four pieces.

    The exponent of the piece for large statistics is a parabola; the p-value stays at its least value (about 1e-190) beyond its vertex.
    """
    n, m, s = df.agg(F.count(x), F.avg(x), F.stddev_pop(x)).first()
    if n and not s:  # all values are equal
        return _result(df.sparkSession, 0.0, 1.0, None)
    f = dist.Normal(m, s).cdf_column(F.col(x))
    ranked = _ecdf(df, x).withColumn("f", F.least(F.greatest(f, F.lit(1e-15)), F.lit(1 - 1e-15)))
    # sum over ranks i of (2i - 1) ln F and (2(n - i) + 1) ln(1 - F), grouped by equal values
    first = F.col("upto") - F.col("c")
    lower = F.col("c") * (F.col("upto") + first)
    upper = 2 * F.lit(n) * F.col("c") - lower
    a2 = -n - ranked.agg(F.sum(lower * F.log("f") + upper * F.log1p(-F.col("f")))).first()[0] / n
    a = a2 * (1 + 0.75 / n + 2.25 / n**2)
    if a >= 0.6:
        far = min(a, 5.709 / (2 * 0.0186))
        p = math.exp(1.2937 - 5.709 * far + 0.0186 * far * far)
    elif a >= 0.34:
        p = math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    elif a >= 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)
    return _result(df.sparkSession, a, p, None)


def beta_binomial(df: DataFrame, success: Column, a: float, b: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Posterior Beta(a + k, b + n - k) per group, with its mean and variance."""
    s = df.groupBy(*by).agg(F.count_if(success).alias("k"), F.count("*").alias("n"))
    s = s.withColumn("alpha", a + F.col("k")).withColumn("beta", b + F.col("n") - F.col("k"))
    total = F.col("alpha") + F.col("beta")
    return s.withColumn("mean", F.col("alpha") / total).withColumn("variance", F.col("alpha") * F.col("beta") / (total * total * (total + 1)))


def gamma_poisson(df: DataFrame, count: str, shape: float, rate: float, by: tuple[str, ...] = ()) -> DataFrame:
    s = df.groupBy(*by).agg((shape + F.sum(count)).alias("shape"), (rate + F.count(count)).alias("rate"))
    return s.withColumn("mean", F.col("shape") / F.col("rate"))


def normal_normal(df: DataFrame, x: str, mean: float, variance: float, noise: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Posterior of a normal mean: precisions add up."""
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("total"))
    precision = 1 / variance + F.col("n") / noise
    return s.select(*by, "n", ((mean / variance + F.col("total") / noise) / precision).alias("mean"), (1 / precision).alias("variance"))


def _interval(cdf, low: float, high, level: float):
    """A function of two parameter columns: the interval that leaves the same share on either side, as a struct lo, hi."""

    @F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x, y = a.to_numpy(float), b.to_numpy(float)
        out = {}
        for name, share in (("lo", (1 - level) / 2), ("hi", (1 + level) / 2)):
            lo, hi = np.full(len(x), low), np.broadcast_to(high(x, y), len(x)).astype(float)
            for _ in range(100):
                middle = (lo + hi) / 2
                under = cdf(x, y, middle) < share
                lo, hi = np.where(under, middle, lo), np.where(under, hi, middle)
            out[name] = (lo + hi) / 2
        return pd.DataFrame(out)

    return run


def beta_interval(alpha: Column, beta: Column, level: float = 0.95) -> Column:
    """Credible interval of a Beta posterior."""
    return _interval(special.betainc, 0.0, lambda a, b: 1.0, level)(alpha.cast("double"), beta.cast("double"))


def gamma_interval(shape: Column, rate: Column, level: float = 0.95) -> Column:
    """Credible interval of a Gamma posterior."""
    return _interval(lambda a, b, x: special.gammainc(a, b * x), 0.0, lambda a, b: (a + 40 * np.sqrt(a) + 40) / b, level)(shape.cast("double"), rate.cast("double"))


def normal_interval(mean: Column, variance: Column, level: float = 0.95) -> Column:
    """Credible interval of a normal posterior."""
    z = float(_NORMAL.quantile(np.array([(1 + level) / 2]))[0])
    return F.struct((mean - z * F.sqrt(variance)).alias("lo"), (mean + z * F.sqrt(variance)).alias("hi"))


@F.pandas_udf(T.DoubleType())
def _log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(special.lgamma(x.to_numpy(float)))


def log_evidence(k: Column, n: Column, a: float, b: float) -> Column:
    """Logarithm of the probability of k hits in n under a Beta(a, b) prior."""
    g = lambda x: _log_gamma(x.cast("double"))
    choose = g(n + 1) - g(k + 1) - g(n - k + 1)
    return choose + g(k + a) + g(n - k + b) - g(n + a + b) - F.lit(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def bayes_factor(log_one: Column, log_two: Column) -> Column:
    """How much better the first model explains the data than the second."""
    return F.exp(log_one - log_two)
