"""Descriptive statistics, correlation, regression and time series, per group of ``by``.

Null values are left out. Float sums depend on the order of partial sums in the last bits only.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sequence import ranged, scan
from millrace.plans.storage import cut

Cols = tuple[str, ...] | list[str]


def describe(df: DataFrame, value: str, by: Cols = (), quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """n, mean, median, variances, standard deviations, skewness and excess kurtosis (0 where all values are equal), quantiles by linear interpolation."""
    x = F.col(value).cast("double")
    out = [
        F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.percentile(x, F.array(F.lit(0.5), *map(F.lit, quantiles))).alias("_quantiles"),
        F.var_pop(x).alias("var_pop"), F.var_samp(x).alias("var_samp"), F.stddev_pop(x).alias("std_pop"), F.stddev_samp(x).alias("std_samp"),
        F.coalesce(F.skewness(x), F.lit(0.0)).alias("skewness"), F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"),
    ]
    rows = df.groupBy(*by).agg(*out)  # all quantiles come from one map of values and their counts
    names = ["median", *(f"q{round(q * 100)}" for q in quantiles)]
    return rows.select(*by, *(F.col("_quantiles")[k].alias(name) for k, name in enumerate(names)), *(c for c in rows.columns if c not in (*by, "_quantiles")))


def mode(df: DataFrame, value: str, by: Cols = ()) -> DataFrame:
    """The most frequent value, the smallest on a tie. Counts are made first, so a hot value is summed where it lies."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("mode"), F.max("count").alias("n"))


def histogram(df: DataFrame, value: str, bins: int, by: Cols = ()) -> DataFrame:
    """bin, lo, hi, n over equal bins from least to greatest; the greatest falls into the last bin, empty bins are listed."""
    if bins < 1:
        raise ValueError("bins must be positive")
    x = F.col(value).cast("double")
    ends = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).where("_lo is not null")
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(1.0)
    ends = ends.withColumn("_w", width)
    joined = df.where(F.col(value).isNotNull()).join(ends, list(by)) if by else df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    counts = joined.withColumn("bin", F.least(F.floor((x - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("long")).groupBy(*by, "bin").count()
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), F.coalesce("count", F.lit(0)).alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """xbin, ybin, n over the cells that have rows."""
    ends = df.agg(*(f(F.col(c).cast("double")).alias(n) for c, k in ((x, "x"), (y, "y")) for f, n in ((F.min, f"_lo{k}"), (F.max, f"_hi{k}"))))

    def place(c: str, k: str) -> Column:
        width = F.when(F.col(f"_hi{k}") > F.col(f"_lo{k}"), (F.col(f"_hi{k}") - F.col(f"_lo{k}")) / bins).otherwise(1.0)
        return F.least(F.floor((F.col(c) - F.col(f"_lo{k}")) / width), F.lit(bins - 1)).cast("long")

    return df.crossJoin(F.broadcast(ends)).groupBy(place(x, "x").alias("xbin"), place(y, "y").alias("ybin")).agg(F.count("*").alias("n"))


def _safe_ratio(top: Column, under: Column) -> Column:
    return F.when(under > 0, F.least(F.greatest(top / under, F.lit(-1.0)), F.lit(1.0)))


def pearson(df: DataFrame, x: str, y: str, by: Cols = ()) -> DataFrame:
    """r from -1 to 1; null where either does not vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    return rows.groupBy(*by).agg(F.covar_pop(a, b).alias("_c"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("_s")).select(*by, _safe_ratio(F.col("_c"), F.col("_s")).alias("r"))


def average_rank(df: DataFrame, value: str, by: Cols = (), out: str = "rank") -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs. Ranks come from counts of distinct values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = scan(counts, "_n", [value], by, inclusive=False, out="_before").withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before")
    return df.join(ranked, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: Cols = ()) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pearson(average_rank(average_rank(rows, x, by, "_rx"), y, by, "_ry"), "_rx", "_ry", by)


def inversions(rank, weight) -> int:
    """Weight of the pairs of places of which the earlier has the higher rank (whole numbers from 0), bit by bit of the rank."""
    import numpy as np

    rank, weight, total = np.asarray(rank, "int64"), np.asarray(weight, "int64"), 0
    for bit in reversed(range(int(rank.max()).bit_length() if len(rank) else 0)):
        high, one = rank >> (bit + 1), rank >> bit & 1  # equal high bits lie together, in their order
        upto = np.cumsum(weight * one)
        starts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        before = np.repeat((upto - weight * one)[starts], np.diff(np.append(starts, len(rank))))
        total += int((weight * (1 - one) * (upto - before)).sum())
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def _inversions_within(order_by: list[str], of: str):
    """A task's inversions of ``of`` among its rows, sorted; ``n`` weighs them."""
    import numpy as np

    def run(batches):
        if rows := [b for b in batches if len(b)]:
            pdf = pd.concat(rows).sort_values(order_by)
            yield pd.DataFrame({"d": [inversions(np.unique(pdf[of].to_numpy(), return_inverse=True)[1], pdf["n"].to_numpy())]})

    return run


def _tied(counts: DataFrame, by: Cols) -> int:
    """Pairs of rows that are equal in ``by``."""
    n = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    return n.agg(F.expr("coalesce(sum(n * (n - 1) div 2), 0)")).first()[0]


def _discordant(counts: DataFrame) -> int:
    """Pairs with x less and y greater, of rows (x, y, n).

    Rows are dealt by (x, y), and a task counts the pairs of its share. For pairs of two shares, rows dealt by y count how many
    lie in a later share and have a lesser y; beyond that the counts by share of either kind are enough, a few numbers.
    """
    by_x = ranged(counts, ["x", "y"]).withColumnRenamed("_part", "share")
    by_y = ranged(by_x.groupBy("y", "share").agg(F.sum("n").alias("n")), ["y", "share"])
    inside = by_x.mapInPandas(_inversions_within(["x", "y"], "y"), "d long").union(by_y.mapInPandas(_inversions_within(["y", "share"], "share"), "d long"))
    cells = sorted(tuple(r) for r in by_y.groupBy("_part", "share").agg(F.sum("n")).collect())  # by partitions, not by rows
    return (inside.agg(F.sum("d")).first()[0] or 0) + inversions([r[1] for r in cells], [r[2] for r in cells])


def kendall(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """tau-b over all pairs of rows of different keys; pairs tied in both are left out. Pairs are counted by order, never listed, but those that share a key."""
    rows = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    counts = cut(rows.groupBy("x", "y").agg(F.count("*").alias("n")))
    pairs, both = _tied(counts, []), _tied(counts, ["x", "y"])
    tx, ty, discordant = _tied(counts, ["x"]) - both, _tied(counts, ["y"]) - both, _discordant(counts)
    concordant = pairs - both - tx - ty - discordant
    again = cut(rows.join(rows.groupBy("k").count().where("count > 1"), "k", "left_semi").groupBy("k", "x", "y").agg(F.count("*").alias("n")))
    if not again.isEmpty():
        a, b = (again.select("k", *(F.col(c).alias(f"{c}{i}") for c in "xyn")) for i in "ab")
        dx, dy, n = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb")), F.col("na") * F.col("nb")
        twice = a.join(b, "k").agg(*(F.coalesce(F.sum(F.when(c, n)), F.lit(0)) for c in (dx * dy > 0, dx * dy < 0, (dx == 0) & (dy != 0), (dy == 0) & (dx != 0)))).first()
        concordant, discordant, tx, ty = (v - t // 2 for v, t in zip((concordant, discordant, tx, ty), twice))
    size = math.sqrt((concordant + discordant + tx) * (concordant + discordant + ty))
    tau = min(max((concordant - discordant) / size, -1.0), 1.0) if size else 0.0
    return df.sparkSession.createDataFrame([(concordant, discordant, tau)], "concordant long, discordant long, tau double")


def covariance_matrix(df: DataFrame, columns: Cols) -> DataFrame:
    """(a, b, cov) for all pairs of columns, from one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*(F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs))).alias("p")).select("p.*")


def ols(df: DataFrame, x: str, y: str, by: Cols = ()) -> DataFrame:
    """slope, intercept, r2 (1 where y does not vary), residual standard error, slope standard error; null slope where x does not vary."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"), F.covar_pop(a, b).alias("c"))
    slope = F.when(F.col("vx") > 0, F.col("c") / F.when(F.col("vx") > 0, F.col("vx")))
    s = s.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("sse", F.greatest(F.col("n") * (F.col("vy") - F.col("slope") * F.col("c")), F.lit(0.0)))
    r2 = F.when(F.col("vy") > 0, 1 - F.col("sse") / (F.col("n") * F.when(F.col("vy") > 0, F.col("vy")))).otherwise(1.0)
    error = F.when(F.col("n") > 2, F.sqrt(F.col("sse") / F.when(F.col("n") > 2, F.col("n") - 2))).otherwise(0.0)
    return s.select(*by, "n", "slope", "intercept", r2.alias("r2"), error.alias("std_error"), F.when(F.col("vx") > 0, error / F.sqrt(F.col("n") * F.when(F.col("vx") > 0, F.col("vx")))).alias("slope_error"))


def residuals(df: DataFrame, x: str, y: str, by: Cols = ()) -> DataFrame:
    line = ols(df, x, y, by).select(*by, "slope", "intercept")
    joined = df.join(line, list(by)) if by else df.crossJoin(F.broadcast(line))  # one row
    return joined.withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(x)).withColumn("residual", F.col(y) - F.col("predicted"))


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients from the constant up: moments in one aggregate, a small solve on the driver. x is scaled to keep the moments tame."""
    import numpy as np

    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    mean, std = rows.agg(F.avg(a), F.stddev_pop(a)).first()
    z = (a - F.lit(mean)) / F.lit(std or 1.0)
    sums = rows.agg(*(F.sum(F.pow(z, k)).alias(f"m{k}") for k in range(2 * degree + 1)), *(F.sum(F.pow(z, k) * b).alias(f"v{k}") for k in range(degree + 1))).first()
    m = np.array([[sums[f"m{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    w = np.linalg.lstsq(m, np.array([sums[f"v{k}"] for k in range(degree + 1)]), rcond=None)[0]
    line = np.poly1d([1 / (std or 1.0), -mean / (std or 1.0)])
    total = np.poly1d([0.0])
    for k, c in enumerate(w):
        total = total + c * line**k
    return (list(total.coeffs[::-1]) + [0.0] * (degree + 1))[: degree + 1]


def polyval(coefficients: list[float], x: Column) -> Column:
    """Horner's rule; coefficients from the constant up."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def _series(order_by: Cols, by: Cols) -> Window:
    return Window.partitionBy(*by).orderBy(*order_by)


def moving_average(df: DataFrame, value: str, width: int, order_by: Cols, by: Cols, out: str = "sma") -> DataFrame:
    """Mean of the last ``width`` values; null until there are as many."""
    w = _series(order_by, by)
    return df.withColumn(out, F.when(F.row_number().over(w) >= width, F.avg(value).over(w.rowsBetween(1 - width, 0))))


def weighted_average(df: DataFrame, value: str, width: int, order_by: Cols, by: Cols, out: str = "wma") -> DataFrame:
    """Weights 1 to ``width``, the newest the heaviest; null until there are as many values."""
    w = _series(order_by, by)
    total = sum((F.lag(value, width - k).over(w) * k for k in range(1, width + 1)), F.lit(0.0))
    return df.withColumn(out, F.when(F.row_number().over(w) >= width, total / (width * (width + 1) / 2)))


def exponential_average(df: DataFrame, value: str, width: int, order_by: Cols, by: Cols, out: str = "ema") -> DataFrame:
    """y0 = x0, then alpha x + (1 - alpha) y with alpha = 2 / (width + 1).

    A recurrence needs its series in order: each group is one table of a task, so groups must fit one. Null values count as 0.
    """
    alpha = 2.0 / (width + 1)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order_by), kind="stable", ignore_index=True)
        y, averages = 0.0, []
        for k, x in enumerate(group[out].fillna(0.0).to_numpy()):
            y = x if k == 0 else alpha * x + (1 - alpha) * y
            averages.append(y)
        group[out] = averages
        return group

    rows = df.select(*by, *order_by, F.col(value).cast("double").alias(out))
    return rows.groupBy(*by).applyInPandas(fold, rows.schema)


def autocorrelation(df: DataFrame, value: str, lags: int, order_by: Cols, by: Cols) -> DataFrame:
    """(lag, acf) from 0 to ``lags``: mean product of deviations over n, by the population variance; null if that is 0."""
    w = _series(order_by, by)
    whole = Window.partitionBy(*by)
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    shifted = d.select(*by, "_d", *(F.lead("_d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)))
    sums = shifted.groupBy(*by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s0"), *(F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)))
    long = sums.select(*by, "_s0", F.posexplode(F.array(*(F.coalesce(f"_s{k}", F.lit(0.0)) for k in range(lags + 1)))).alias("lag", "_s"))
    return long.select(*by, "lag", F.when(F.col("_s0") > 0, F.col("_s") / F.when(F.col("_s0") > 0, F.col("_s0"))).alias("acf"))


def difference(df: DataFrame, value: str, order_by: Cols, by: Cols, out: str = "diff") -> DataFrame:
    """x less the value before; the first row of a series goes."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(_series(order_by, by))).where(F.col(out).isNotNull())


def decompose(df: DataFrame, value: str, period: int, order_by: Cols, by: Cols) -> DataFrame:
    """Additive parts trend, seasonal, rest. The trend is a centred mean, with half weights at the ends if the period is even; null at the edges."""
    if period < 2:
        raise ValueError("a period has two steps at least")
    w, half = _series(order_by, by), period // 2
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_n", n)
    middle = F.sum(value).over(w.rowsBetween(-half, half))
    trend = (middle - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2) / period if period % 2 == 0 else middle / period
    rows = rows.withColumn("trend", F.when((F.col("_pos") >= half) & (F.col("_pos") < F.col("_n") - half), trend)).withColumn("_phase", F.col("_pos") % period)
    phases = rows.groupBy(*by, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_raw"))
    phases = phases.withColumn("seasonal", F.col("_raw") - F.avg("_raw").over(Window.partitionBy(*by))).drop("_raw")
    return rows.join(phases, [*by, "_phase"]).withColumn("rest", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_pos", "_n", "_phase")


def cross_correlation(df: DataFrame, x: str, y: str, pos: str, most: int) -> DataFrame:
    """(lag, value): sum of x[i] y[i + lag] for all lags from -most to most, of a series with whole-number positions."""
    a = df.select(F.col(pos).alias("i"), F.col(x).alias("x"))
    spread = a.select("x", F.explode(F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda k: F.struct(k.alias("lag"), (F.col("i") + k).alias("j")))).alias("t")).select("x", "t.lag", "t.j")
    b = df.select(F.col(pos).alias("j"), F.col(y).alias("y"))
    return spread.join(b, "j").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
