"""Signals and numerical methods on series (pos, x) and on arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Positions of the shorter series of a convolution.
TAPS = 100_000


def convolve(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pos, x): full linear convolution of two series with positions from 0; ``b`` has ``TAPS`` positions at most and is broadcast."""
    right = b.select(F.col("pos").alias("_p"), F.col("x").alias("_x"))
    if right.limit(TAPS + 1).count() > TAPS:
        raise ValueError(f"the second series has more than {TAPS} positions: cut it into blocks and add up their convolutions")
    return a.crossJoin(F.broadcast(right)).groupBy((F.col("pos") + F.col("_p")).alias("pos")).agg(F.sum(F.col("x") * F.col("_x")).alias("x"))


def correlate(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """(pos, x): sum of a[k] b[k + pos] for lags from 0 to ``most``, by an equality join on a[k]'s positions shifted by each lag."""
    right = b.select(F.col("pos").cast("long").alias("_p"), F.col("x").alias("_x"))
    spread = a.select("x", F.col("pos").cast("long").alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long"))).alias("pos"))
    return spread.join(right, F.col("_p") == F.col("_k") + F.col("pos")).groupBy("pos").agg(F.sum(F.col("x") * F.col("_x")).alias("x"))


def fir(df: DataFrame, taps: list[float], order_by: list[str], by: list[str], value: str = "x", out: str = "y") -> DataFrame:
    """Finite filter with a zero initial state: a sum of lags."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn(out, sum((F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * t for k, t in enumerate(taps)), F.lit(0.0)))


def iir_of(x: np.ndarray, b: list[float], a: list[float]) -> np.ndarray:
    """y of the difference equation with a[0] = 1 and zero initial state."""
    if abs(a[0] - 1) > 1e-12:
        raise ValueError("a[0] must be 1")
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(c * x[n - k] for k, c in enumerate(b) if n >= k) - sum(c * y[n - k] for k, c in enumerate(a) if k and n >= k)
    return y


def array_function(f, kind=T.DoubleType()):
    """A column function array<double> -> array of a numpy function; null stays null."""

    @F.pandas_udf(T.ArrayType(kind))
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.asarray(f(np.asarray(x, float))).tolist())

    return run


def _power_of_two(n: int) -> None:
    if n < 1 or n & (n - 1):
        raise ValueError("the length must be a power of two")


def fft(x: Column) -> Column:
    """Real and imaginary parts by turns; lengths are powers of two."""

    def run(v):
        _power_of_two(len(v))
        z = np.fft.fft(v)
        return np.stack([z.real, z.imag], axis=1).ravel()

    return array_function(run)(x)


def ifft(x: Column) -> Column:
    return array_function(lambda v: np.fft.ifft(v[0::2] + 1j * v[1::2]).real)(x)


def dct(x: Column) -> Column:
    """Cosine transform of the second kind, unscaled."""

    def run(v):
        n = len(v)
        return np.cos(np.pi / n * np.outer(np.arange(n), np.arange(n) + 0.5)) @ v

    return array_function(run)(x)


def idct(x: Column) -> Column:
    def run(v):
        n = len(v)
        return (v[0] / 2 + np.cos(np.pi / n * np.outer(np.arange(n) + 0.5, np.arange(1, n))) @ v[1:]) * 2 / n

    return array_function(run)(x)


def periodogram(x: Column) -> Column:
    """One-sided power: squares over n squared, doubled but for the first and last."""

    def run(v):
        _power_of_two(len(v))
        p = np.abs(np.fft.rfft(v)) ** 2 / len(v) ** 2
        p[1:-1] *= 2
        return p

    return array_function(run)(x)


def welch(x: Column, segment: int = 256, overlap: int | None = None) -> Column:
    """Mean power of Hann-windowed segments; a segment is the largest power of two that fits."""

    def run(v):
        size = 1 << (min(segment, len(v)).bit_length() - 1)
        step = size - (size // 2 if overlap is None else overlap)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / max(size - 1, 1))
        parts = [np.abs(np.fft.rfft(v[i : i + size] * hann)) ** 2 / (hann**2).sum() for i in range(0, len(v) - size + 1, step)]
        p = np.mean(parts, axis=0)
        p[1:-1] *= 2
        return p

    return array_function(run)(x)


def window_weights(spark, kind: str, n: int) -> DataFrame:
    """(pos, w) of a symmetric window."""
    terms = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}
    rows = spark.range(n).withColumnRenamed("id", "pos")
    if n == 1:
        return rows.withColumn("w", F.lit(1.0))
    t = F.col("pos") / (n - 1)
    if kind == "bartlett":
        return rows.withColumn("w", 1 - F.abs(2 * t - 1))
    a, b, c = terms[kind]
    return rows.withColumn("w", a - b * F.cos(2 * math.pi * t) + c * F.cos(4 * math.pi * t))


def dft_power(df: DataFrame, pos: str, value: str, n: int, bins: int) -> DataFrame:
    """(bin, power) of a series of n values as one aggregate, for any n."""
    k = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    rows = df.select(F.col(pos).alias("_p"), F.col(value).alias("_x"), k)
    angle = 2 * math.pi * F.col("bin") * F.col("_p") / n
    g = rows.groupBy("bin").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), F.sum(F.col("_x") * F.sin(angle)).alias("im"))
    return g.select("bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def trapezoid(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Area under samples in the order of x."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_a", part).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def simpson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Area by parabolas over each pair of steps; null unless the number of samples is odd and at least 3. Unequal steps count with the mean of their pair."""
    w = Window.partitionBy(*by).orderBy(x)
    rows = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    part = (F.col(x) - F.lag(x, 2).over(w)) / 6 * (F.lag(y, 2).over(w) + 4 * F.lag(y).over(w) + F.col(y))
    rows = rows.withColumn("_a", F.when(F.col("_r") % 2 == 1, part))
    return rows.groupBy(*by).agg(F.when((F.max("_n") % 2 == 1) & (F.max("_n") > 2), F.sum("_a")).alias("area"))


def gradient(df: DataFrame, y: str, dx: float, order_by: list[str], by: list[str], out: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    return df.withColumn(out, F.coalesce((after - before) / (2 * dx), (after - F.col(y)) / dx, (F.col(y) - before) / dx))


def interpolate(points: DataFrame, samples: DataFrame, at: str, x: str, y: str, by: list[str], out: str = "value") -> DataFrame:
    """Linear between the samples beside each point, constant beyond the ends. One window per key over both sides."""
    s = samples.select(*by, F.col(x).cast("double").alias("_t"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_side"))
    p = points.withColumn("_t", F.col(at).cast("double")).withColumn("_side", F.lit(1))
    w = Window.partitionBy(*by).orderBy("_t", "_side")
    left, right = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    rows = p.unionByName(s, allowMissingColumns=True)
    for name, c, frame, pick in (("x0", "_x", left, F.last), ("y0", "_y", left, F.last), ("x1", "_x", right, F.first), ("y1", "_y", right, F.first)):
        rows = rows.withColumn(f"_{name}", pick(c, ignorenulls=True).over(frame))
    share = (F.col("_t") - F.col("_x0")) / F.when(F.col("_x1") != F.col("_x0"), F.col("_x1") - F.col("_x0"))
    value = F.coalesce(F.col("_y0") + share * (F.col("_y1") - F.col("_y0")), F.col("_y0"), F.col("_y1"))
    return rows.where("_side = 1").withColumn(out, value).select(*points.columns, out)


# Methods over plain functions, on the driver
def bisect(f, lo: float, hi: float, tol: float = 1e-12) -> float:
    a, b = f(lo), f(hi)
    if a * b > 0:
        raise ValueError("no change of sign")
    while hi - lo > tol:
        mid = (lo + hi) / 2
        if a * (c := f(mid)) <= 0:
            hi = mid
        else:
            lo, a = mid, c
    return (lo + hi) / 2


def newton(f, df, x: float, tol: float = 1e-12, rounds: int = 100) -> float:
    for _ in range(rounds):
        step = f(x) / df(x)
        x -= step
        if abs(step) < tol:
            return x
    raise RuntimeError("no convergence")


def secant(f, a: float, b: float, tol: float = 1e-12, rounds: int = 100) -> float:
    for _ in range(rounds):
        fa, fb = f(a), f(b)
        if fa == fb:
            return b
        a, b = b, b - fb * (b - a) / (fb - fa)
        if abs(b - a) < tol:
            return b
    raise RuntimeError("no convergence")


def quadrature(f, a: float, b: float, tol: float = 1e-10, depth: int = 50) -> float:
    """Adaptive Simpson."""

    def go(a, fa, b, fb, m, fm, whole, tol, depth):
        l, r = (a + m) / 2, (m + b) / 2
        fl, fr = f(l), f(r)
        left, right = (m - a) / 6 * (fa + 4 * fl + fm), (b - m) / 6 * (fm + 4 * fr + fb)
        if depth <= 0 or abs(left + right - whole) <= 15 * tol:
            return left + right + (left + right - whole) / 15
        return go(a, fa, m, fm, l, fl, left, tol / 2, depth - 1) + go(m, fm, b, fb, r, fr, right, tol / 2, depth - 1)

    m = (a + b) / 2
    fa, fm, fb = f(a), f(m), f(b)
    return go(a, fa, b, fb, m, fm, (b - a) / 6 * (fa + 4 * fm + fb), tol, depth)


def gauss_legendre(f, a: float, b: float, n: int = 16) -> float:
    x, w = np.polynomial.legendre.leggauss(n)
    return float((b - a) / 2 * sum(wi * f((b - a) / 2 * xi + (a + b) / 2) for xi, wi in zip(x, w)))


def runge_kutta(f, t0: float, y0, t1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Fourth order; times and states."""
    h, t, y = (t1 - t0) / steps, t0, np.atleast_1d(np.asarray(y0, float))
    ts, ys = [t], [y]
    for _ in range(steps):
        k1 = np.asarray(f(t, y))
        k2 = np.asarray(f(t + h / 2, y + h / 2 * k1))
        k3 = np.asarray(f(t + h / 2, y + h / 2 * k2))
        k4 = np.asarray(f(t + h, y + h * k3))
        t, y = t + h, y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        ts.append(t)
        ys.append(y)
    return np.array(ts), np.array(ys)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural spline."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n, h = len(x), np.diff(x)
    a, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return m[k] * u**3 / (6 * h[k]) + m[k + 1] * v**3 / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def minimise(f, grad, x0, memory: int = 10, rounds: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Limited-memory BFGS with a Wolfe line search; f and grad may be Spark aggregates."""
    x = np.asarray(x0, float)
    fx, g, past = f(x), np.asarray(grad(x)), []
    for _ in range(rounds):
        if np.abs(g).max() < tol:
            break
        q, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            q -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            q += s * (a - y @ q / (y @ s))
        step, slope, low, high = 1.0, -(g @ q), 0.0, math.inf
        for _ in range(60):  # weak Wolfe conditions by bisection
            new = x - step * q
            g_new = np.asarray(grad(new))
            if f(new) > fx + 1e-4 * step * slope:
                high = step
            elif -(g_new @ q) < 0.9 * slope:
                low = step
            else:
                break
            step = 2 * low if high == math.inf else (low + high) / 2
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        if np.abs(s).max() < 1e-14:
            break
        x, g, fx = new, g_new, f(new)
    return x


def nelder_mead(f, x0, scale: float = 1.0, rounds: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Simplex search without derivatives."""
    n = len(x0)
    points = [np.asarray(x0, float)] + [np.asarray(x0, float) + scale * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol:
            break
        centre = np.mean(points[:-1], axis=0)
        trial = centre + (centre - points[-1])
        ft = f(trial)
        if ft < values[0]:
            far = centre + 2 * (centre - points[-1])
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < ft else (trial, ft)
        elif ft < values[-2]:
            points[-1], values[-1] = trial, ft
        else:
            near = centre + 0.5 * (points[-1] - centre)
            fn = f(near)
            if fn < values[-1]:
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]
