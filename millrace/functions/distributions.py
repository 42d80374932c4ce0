"""Probability distributions as column functions: density or mass, distribution function, quantile, log density, sample.

Where a closed form exists the result is a plain SQL expression; others are Arrow-batched functions over numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import special


def _vector(f):
    """A pandas UDF double -> double of a numpy function; null stays null."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        values = x.to_numpy(float, na_value=np.nan)
        out = np.full(len(values), np.nan)
        ok = ~np.isnan(values)
        out[ok] = f(values[ok])
        return pd.Series(out).where(ok, None)

    return run


def _bisect(cdf, p: np.ndarray, lo: float, hi: float) -> np.ndarray:
    a, b = np.full(len(p), lo), np.full(len(p), hi)
    for _ in range(200):
        m = (a + b) / 2
        low = cdf(m) < p
        a, b = np.where(low, m, a), np.where(low, b, m)
    return (a + b) / 2


class Distribution:
    """pdf, cdf and quantile work on numpy arrays; the *_column forms on columns."""

    def pdf(self, x):
        return np.exp(self.logpdf(x))

    def pdf_column(self, x: Column) -> Column:
        return _vector(self.pdf)(x.cast("double"))

    def cdf_column(self, x: Column) -> Column:
        return _vector(self.cdf)(x.cast("double"))

    def quantile_column(self, p: Column) -> Column:
        return _vector(self.quantile)(p.cast("double"))

    def logpdf_column(self, x: Column) -> Column:
        return _vector(self.logpdf)(x.cast("double"))

    def sample_column(self, seed: int) -> Column:
        """A random draw per row, by the quantile of a uniform number."""
        return self.quantile_column(F.rand(seed))


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        _positive(sigma=self.sigma)

    def logpdf(self, x):
        return -0.5 * ((x - self.mu) / self.sigma) ** 2 - math.log(self.sigma * math.sqrt(2 * math.pi))

    def cdf(self, x):
        return 0.5 * (1 + special.erf((np.asarray(x) - self.mu) / (self.sigma * math.sqrt(2))))

    def quantile(self, p):
        inv = NormalDist(self.mu, self.sigma).inv_cdf
        return np.array([inv(v) if 0 < v < 1 else (-math.inf if v == 0 else math.inf if v == 1 else math.nan) for v in p])

    def pdf_column(self, x):
        z = (x - self.mu) / self.sigma
        return F.exp(-z * z / 2) / (self.sigma * math.sqrt(2 * math.pi))

    def sample_column(self, seed):
        return self.mu + self.sigma * F.randn(seed)


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float

    def __post_init__(self):
        _positive(rate=self.rate)

    def logpdf(self, x):
        return np.where(np.asarray(x) < 0, -np.inf, math.log(self.rate) - self.rate * np.asarray(x))

    def cdf(self, x):
        return -np.expm1(-self.rate * np.maximum(x, 0))

    def quantile(self, p):
        return -np.log1p(-np.asarray(p)) / self.rate

    def pdf_column(self, x):
        return F.when(x < 0, 0.0).otherwise(self.rate * F.exp(-self.rate * x))

    def cdf_column(self, x):
        return F.when(x < 0, 0.0).otherwise(-F.expm1(-self.rate * x))

    def quantile_column(self, p):
        return -F.log1p(-p) / self.rate


@dataclass(frozen=True)
class Uniform(Distribution):
    a: float
    b: float

    def __post_init__(self):
        _positive(width=self.b - self.a)

    def logpdf(self, x):
        return np.where((x >= self.a) & (x <= self.b), -math.log(self.b - self.a), -np.inf)

    def cdf(self, x):
        return np.clip((np.asarray(x) - self.a) / (self.b - self.a), 0, 1)

    def quantile(self, p):
        return self.a + np.asarray(p) * (self.b - self.a)

    def pdf_column(self, x):
        return F.when((x >= self.a) & (x <= self.b), 1 / (self.b - self.a)).otherwise(0.0)

    def cdf_column(self, x):
        return F.least(F.greatest((x - self.a) / (self.b - self.a), F.lit(0.0)), F.lit(1.0))

    def quantile_column(self, p):
        return self.a + p * (self.b - self.a)


@dataclass(frozen=True)
class Gamma(Distribution):
    shape: float
    scale: float

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)

    def logpdf(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (self.shape - 1) * np.log(x) - x / self.scale - math.lgamma(self.shape) - self.shape * math.log(self.scale)
        return np.where(x < 0, -np.inf, y)

    def cdf(self, x):
        return special.gammainc(self.shape, np.maximum(x, 0) / self.scale)

    def quantile(self, p):
        top = self.shape * self.scale + 40 * math.sqrt(self.shape) * self.scale + 100 * self.scale
        return _bisect(self.cdf, np.asarray(p, float), 0.0, top)


def ChiSquared(k: float) -> Gamma:
    return Gamma(k / 2, 2.0)


@dataclass(frozen=True)
class Beta(Distribution):
    a: float
    b: float

    def __post_init__(self):
        _positive(a=self.a, b=self.b)

    def logpdf(self, x):
        x = np.asarray(x, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (self.a - 1) * np.log(x) + (self.b - 1) * np.log1p(-x) - math.log(special.beta(self.a, self.b))
        return np.where((x < 0) | (x > 1), -np.inf, y)

    def cdf(self, x):
        return special.betainc(self.a, self.b, x)

    def quantile(self, p):
        return _bisect(self.cdf, np.asarray(p, float), 0.0, 1.0)


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float

    def __post_init__(self):
        _positive(df=self.df)

    def logpdf(self, x):
        v = self.df
        return math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * np.log1p(np.asarray(x) ** 2 / v)

    def cdf(self, x):
        x = np.asarray(x, float)
        tail = 0.5 * special.betainc(self.df / 2, 0.5, self.df / (self.df + x * x))
        return np.where(x >= 0, 1 - tail, tail)

    def quantile(self, p):
        return _bisect(self.cdf, np.asarray(p, float), -1e6, 1e6)


@dataclass(frozen=True)
class FDist(Distribution):
    d1: float
    d2: float

    def __post_init__(self):
        _positive(d1=self.d1, d2=self.d2)

    def logpdf(self, x):
        x, a, b = np.asarray(x, float), self.d1, self.d2
        with np.errstate(divide="ignore", invalid="ignore"):
            y = a / 2 * math.log(a) + b / 2 * math.log(b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log(b + a * x) - math.log(special.beta(a / 2, b / 2))
        return np.where(x < 0, -np.inf, y)

    def cdf(self, x):
        x = np.maximum(np.asarray(x, float), 0)
        return special.betainc(self.d1 / 2, self.d2 / 2, self.d1 * x / (self.d1 * x + self.d2))

    def quantile(self, p):
        return _bisect(self.cdf, np.asarray(p, float), 0.0, 1e6)


class Discrete(Distribution):
    """pmf, cdf and quantile of counts; the quantile is the least k whose cdf reaches p."""

    def pdf(self, k):
        return self.pmf(k)

    def logpdf(self, k):
        with np.errstate(divide="ignore"):
            return np.log(self.pmf(k))

    def cdf(self, x):
        k = np.floor(np.asarray(x, float))
        top = int(k.max()) if len(k) else -1
        sums = np.r_[0.0, np.minimum(np.cumsum(self.pmf(np.arange(top + 1))), 1.0)] if top >= 0 else np.zeros(1)
        return sums[np.clip(k.astype(int), -1, top) + 1]

    def quantile(self, p):
        p, most = np.asarray(p, float), self.most()
        sums = np.cumsum(self.pmf(np.arange(most + 1)))
        return np.minimum(np.searchsorted(sums, p - 1e-15), most).astype(float)


@dataclass(frozen=True)
class Bernoulli(Discrete):
    p: float

    def pmf(self, k):
        return np.where(np.asarray(k) == 1, self.p, np.where(np.asarray(k) == 0, 1 - self.p, 0.0))

    def most(self):
        return 1

    def pdf_column(self, x):
        return F.when(x == 1, self.p).when(x == 0, 1 - self.p).otherwise(0.0)


@dataclass(frozen=True)
class Binomial(Discrete):
    n: int
    p: float

    def pmf(self, k):
        k = np.asarray(k, float)
        ok = (k >= 0) & (k <= self.n) & (k == np.floor(k))
        kk = np.where(ok, k, 0)
        if self.p in (0.0, 1.0):
            return np.where(ok & (kk == self.n * self.p), 1.0, 0.0)
        log = special.lgamma(self.n + 1) - special.lgamma(kk + 1) - special.lgamma(self.n - kk + 1) + kk * math.log(self.p) + (self.n - kk) * math.log1p(-self.p)
        return np.where(ok, np.exp(log), 0.0)

    def most(self):
        return self.n


@dataclass(frozen=True)
class Poisson(Discrete):
    rate: float

    def __post_init__(self):
        _positive(rate=self.rate)

    def pmf(self, k):
        k = np.asarray(k, float)
        ok = (k >= 0) & (k == np.floor(k))
        kk = np.where(ok, k, 0)
        return np.where(ok, np.exp(kk * math.log(self.rate) - self.rate - special.lgamma(kk + 1)), 0.0)

    def most(self):
        return min(10_000, int(self.rate + 40 * math.sqrt(self.rate) + 100))


@dataclass(frozen=True)
class Geometric(Discrete):
    """Failures before the first success."""

    p: float

    def pmf(self, k):
        k = np.asarray(k, float)
        return np.where((k >= 0) & (k == np.floor(k)), self.p * (1 - self.p) ** np.maximum(k, 0), 0.0)

    def most(self):
        return 1_000_000

    def cdf(self, x):
        return np.where(np.asarray(x) < 0, 0.0, 1 - (1 - self.p) ** (np.floor(np.maximum(x, 0)) + 1))

    def quantile(self, p):
        p = np.asarray(p, float)
        return np.maximum(np.ceil(np.log1p(-p) / math.log1p(-self.p) - 1 - 1e-12), 0)

    def pdf_column(self, x):
        return F.when(x >= 0, self.p * F.pow(F.lit(1 - self.p), x)).otherwise(0.0)


@dataclass(frozen=True)
class MultivariateNormal:
    """Density over array columns, by a Cholesky factor."""

    mean: tuple
    cov: tuple

    def _parts(self):
        factor = np.linalg.cholesky(np.array(self.cov, float))
        return np.array(self.mean, float), factor

    def mahalanobis_column(self, x: Column) -> Column:
        mean, factor = self._parts()
        inverse = np.linalg.inv(factor)

        @F.pandas_udf(T.DoubleType())
        def run(v: pd.Series) -> pd.Series:
            z = (np.stack(v.to_list()) - mean) @ inverse.T
            return pd.Series(np.sqrt((z * z).sum(axis=1)))

        return run(x)

    def logpdf_column(self, x: Column) -> Column:
        mean, factor = self._parts()
        d = self.mahalanobis_column(x)
        return -0.5 * d * d - float(np.log(np.diag(factor)).sum() + 0.5 * len(mean) * math.log(2 * math.pi))


# Closed forms as plain columns: density and distribution function.
def laplace_cdf(x: Column, mu: float, b: float) -> Column:
    z = (x - mu) / b
    return F.when(z < 0, 0.5 * F.exp(z)).otherwise(1 - 0.5 * F.exp(-z))


def weibull_cdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(-F.expm1(-F.pow(x / scale, shape)))


def pareto_cdf(x: Column, least: float, alpha: float) -> Column:
    return F.when(x < least, 0.0).otherwise(1 - F.pow(least / x, alpha))


def cauchy_cdf(x: Column, at: float, scale: float) -> Column:
    return 0.5 + F.atan((x - at) / scale) / math.pi


def logistic_cdf(x: Column, mu: float, s: float) -> Column:
    return 1 / (1 + F.exp(-(x - mu) / s))


def rayleigh_cdf(x: Column, sigma: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(-F.expm1(-x * x / (2 * sigma * sigma)))


def triangular_cdf(x: Column, a: float, c: float, b: float) -> Column:
    return F.when(x <= a, 0.0).when(x <= c, (x - a) * (x - a) / ((b - a) * (c - a) or 1.0)).when(x < b, 1 - (b - x) * (b - x) / ((b - a) * (b - c) or 1.0)).otherwise(1.0)


def kumaraswamy_cdf(x: Column, a: float, b: float) -> Column:
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(1 - F.pow(1 - F.pow(x, a), b))


def gumbel_cdf(x: Column, mu: float, scale: float) -> Column:
    return F.exp(-F.exp(-(x - mu) / scale))
