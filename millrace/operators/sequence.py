"""Operators on ordered sequences. Every one takes the order explicitly; rows have none of their own.

Without ``by`` the sequence is the whole table. It is then numbered in two phases (rows are dealt by range, numbered
inside their partition, and shifted by the counts of the partitions before), so no single task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.storage import cut

Cols = tuple[str, ...] | list[str]


def ranged(df: DataFrame, order_by: Cols) -> DataFrame:
    dealt = df.repartitionByRange(*(F.col(c) for c in order_by))
    return cut(dealt.withColumn("_part", F.spark_partition_id()))


def _before(sums: DataFrame, value: str) -> DataFrame:
    """Running total of ``value`` over the partitions before; one row per partition, so the window is small."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_base")))


def enumerate_rows(df: DataFrame, order_by: Cols, by: Cols = (), out: str = "pos") -> DataFrame:
    """Position from 0 in the given order, per group of ``by``."""
    if by:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order_by)) - 1).cast("long"))
    rows = ranged(df, order_by)
    base = _before(rows.groupBy("_part").count(), "count")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by)) - 1
    return rows.withColumn("_place", place).join(base, "_part").withColumn(out, (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_place", "_base")


def scan(df: DataFrame, value: str, order_by: Cols, by: Cols = (), inclusive: bool = True, out: str = "scan") -> DataFrame:
    """Running sum, this row's value included or not; an exclusive scan starts with 0. Null values add nothing."""
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    if by:
        w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(*frame)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    rows = ranged(df, order_by)
    base = _before(rows.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum")), "_sum")
    w = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(*frame)
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inside.join(base, "_part").withColumn(out, F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")


def segmented_scan(df: DataFrame, value: str, starts: Column, order_by: Cols, by: Cols = (), out: str = "scan") -> DataFrame:
    """Running sum that begins anew at each row where ``starts`` holds."""
    flagged = df.withColumn("_flag", F.coalesce(starts, F.lit(False)).cast("long"))
    numbered = scan(flagged, "_flag", order_by, by, out="_segment")
    w = Window.partitionBy(*by, "_segment").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn(out, F.sum(value).over(w)).drop("_flag", "_segment")


def running_product(df: DataFrame, value: str, order_by: Cols, by: Cols, out: str = "product") -> DataFrame:
    """Product of the values up to each row, by running sums of logarithms, of signs and of zeros. Null values change nothing."""
    w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    size = F.exp(F.coalesce(F.sum(F.when(x != 0, F.log(F.abs(x)))).over(w), F.lit(0.0)))
    sign = F.when(F.sum((F.coalesce(x, F.lit(1.0)) < 0).cast("int")).over(w) % 2 == 1, -1.0).otherwise(1.0)
    zero = F.sum((F.coalesce(x, F.lit(1.0)) == 0).cast("int")).over(w) > 0
    return df.withColumn(out, F.when(zero, 0.0).otherwise(sign * size))


def zip_rows(left: DataFrame, right: DataFrame, left_order: Cols, right_order: Cols) -> DataFrame:
    """Pairs of rows at the same position; as many as the shorter side has. Column names must differ."""
    a, b = enumerate_rows(left, left_order), enumerate_rows(right, right_order, out="_pos")
    return a.join(b, F.col("pos") == F.col("_pos")).drop("_pos")


def chain(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; ``part`` tells which one a row came from."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


def take(df: DataFrame, n: int, order_by: Cols) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order_by).limit(n)


def skip(df: DataFrame, n: int, order_by: Cols) -> DataFrame:
    """All rows but the first n."""
    return enumerate_rows(df, order_by, out="_pos").where(F.col("_pos") >= n).drop("_pos")


def take_while(df: DataFrame, predicate: Column, order_by: Cols, by: Cols = ()) -> DataFrame:
    """Rows before the first at which the predicate fails (null counts as failing)."""
    failed = df.withColumn("_fail", (~F.coalesce(predicate, F.lit(False))).cast("long"))
    return scan(failed, "_fail", order_by, by, out="_failed").where("_failed = 0").drop("_fail", "_failed")


def skip_while(df: DataFrame, predicate: Column, order_by: Cols, by: Cols = ()) -> DataFrame:
    """Rows from the first at which the predicate fails."""
    failed = df.withColumn("_fail", (~F.coalesce(predicate, F.lit(False))).cast("long"))
    return scan(failed, "_fail", order_by, by, out="_failed").where("_failed > 0").drop("_fail", "_failed")


def partition(df: DataFrame, predicate: Column, out: str = "side") -> DataFrame:
    """Every row with the side it falls on; null counts as false."""
    return df.withColumn(out, F.coalesce(predicate, F.lit(False)))


def flat_map(df: DataFrame, items: Column, out: str = "item") -> DataFrame:
    """A row per item of an array."""
    return df.withColumn(out, F.explode(items))


def map_reduce(df: DataFrame, keys: Column, reducer: Column, key: str = "key", value: str = "value") -> DataFrame:
    """Keys that each row gives (an array), and what the reducer makes of each key's rows."""
    return df.select(F.explode(keys).alias(key), "*").groupBy(key).agg(reducer.alias(value))


def group_values(df: DataFrame, key: str, value: str, out: str = "items") -> DataFrame:
    """Each key with the sorted list of its values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))


def run_lengths(df: DataFrame, value: str, order_by: Cols, by: Cols = ()) -> DataFrame:
    """Runs of equal values in order: run number from 0, value, length."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order_by)
        before = F.lag(F.struct(value)).over(w)
        changed = df.withColumn("_new", (before.isNotNull() & ~before[value].eqNullSafe(F.col(value))).cast("long"))
    else:  # the value before comes by position, so that no task has all rows
        rows = cut(enumerate_rows(df, order_by, out="_at"))
        ahead = rows.select((F.col("_at") + 1).alias("_at"), F.struct(F.col(value).alias("_v")).alias("_before"))
        changed = rows.join(ahead, "_at", "left").withColumn("_new", (F.col("_before").isNotNull() & ~F.col("_before._v").eqNullSafe(F.col(value))).cast("long")).drop("_before", "_at")
    numbered = scan(changed, "_new", order_by, by, out="_run")
    first = F.min("_run").over(Window.partitionBy(*by)) if by else F.lit(0)
    return numbered.withColumn("run", F.col("_run") - first).groupBy(*by, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def delta_encode(df: DataFrame, value: str, order_by: Cols, by: Cols, out: str = "delta") -> DataFrame:
    """The first value of a sequence, then differences."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_decode(df: DataFrame, delta: str, order_by: Cols, by: Cols, out: str = "value") -> DataFrame:
    return scan(df, delta, order_by, by, out=out)


def top_k(df: DataFrame, k: int, order_by: list[Column], by: Cols = ()) -> DataFrame:
    """The first k rows per group; what a heap, a partial sort or a selection is asked for."""
    if not by:
        return df.orderBy(*order_by).limit(k)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))).where(F.col("_rank") <= k).drop("_rank")


def order_statistic(df: DataFrame, value: str, k: int, by: Cols = ()) -> DataFrame:
    """The k-th smallest value (from 0), with repeats."""
    return enumerate_rows(df, [value], by, out="_rank").where(F.col("_rank") == k).select(*by, value)


def upper_median(df: DataFrame, value: str, by: Cols) -> DataFrame:
    """The element at n div 2 of the sorted values, nulls left out; a group is sorted on disk if need be, never one array."""
    group = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("median"), F.row_number().over(group.orderBy(value)).alias("_nth"), F.count("*").over(group).alias("_n"))
    return rows.where(F.col("_nth") == F.floor(F.col("_n") / 2) + 1).select(*by, "median")


def islands(df: DataFrame, value: str, by: Cols = ()) -> DataFrame:
    """Runs of consecutive whole numbers, repeats ignored: first, last and length of each."""
    runs = enumerate_rows(df.select(*by, value).distinct(), [value], by, out="_at").withColumn("_start", F.col(value) - F.col("_at"))
    return runs.groupBy(*by, "_start").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("_start")


def max_subarray(df: DataFrame, value: str, order_by: Cols, by: Cols) -> DataFrame:
    """The largest sum of a run of rows: a running sum less the least running sum before it."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    sums = df.withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.coalesce(F.min("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.lit(0.0))
    return sums.withColumn("_gain", F.col("_sum") - low).groupBy(*by).agg(F.max("_gain").alias("max_sum"))


def best_trade(df: DataFrame, price: str, order_by: Cols, by: Cols) -> DataFrame:
    """Best single buy and sale, and the gain of all rises; neither is negative."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    rows = df.withColumn("_low", F.min(price).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rise", F.col(price) - F.lag(price).over(w))
    return rows.groupBy(*by).agg(F.max(F.col(price) - F.col("_low")).alias("single"), F.sum(F.greatest(F.coalesce("_rise", F.lit(0.0)), F.lit(0.0))).alias("unlimited"))


def trapped_water(df: DataFrame, height: str, order_by: Cols, by: Cols) -> DataFrame:
    """Water that stands between heights."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    left, right = F.max(height).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max(height).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("_water", F.least(left, right) - F.col(height)).groupBy(*by).agg(F.sum("_water").alias("water"))
