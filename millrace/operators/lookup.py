"""Lookups by order, range, interval and distance: what search trees and spatial indexes answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sequence import enumerate_rows, ranged
from millrace.plans.storage import cut

Cols = tuple[str, ...] | list[str]


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: Column, tie: str, by: Cols = (), out: str = "value") -> DataFrame:
    """For each left row the value of the last right row at or before it (ties: the greatest ``tie``).

    Both sides go through one window per key, so rows are sorted once and never joined pair by pair. Without ``by`` the rows
    are dealt by time and what a partition ends with is carried to the next, so that no task has all rows.
    """
    key = list(by)
    # left rows come after right rows of the same time
    l = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType)).withColumn("_v", F.lit(None))
    r = right.select(*key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), value.alias("_v"))
    order = ["_t", "_side", "_tie"]
    rows = l.unionByName(r, allowMissingColumns=True)
    if key:
        rows = rows.withColumn(out, F.last("_v", ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:  # range partitions, and what the last value of those before is, one row a partition
        rows = ranged(rows, order)
        ends = rows.where("_v is not null").groupBy("_part").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
        ends = rows.select("_part").distinct().join(ends, "_part", "left")
        carried = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
        inside = F.last("_v", ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn(out, inside).join(F.broadcast(carried), "_part").withColumn(out, F.coalesce(out, "_carried"))
    return rows.where("_side = 1").select(*left.columns, out)


def neighbours(df: DataFrame, value: str, by: Cols = ()) -> DataFrame:
    """Each distinct value with the next lower and next higher one; without ``by`` through positions, so no task has all values."""
    if not by:
        rows = cut(enumerate_rows(df.select(value).distinct(), [value], out="_at"))
        below, above = rows.select(F.col(value).alias("predecessor"), (F.col("_at") + 1).alias("_at")), rows.select(F.col(value).alias("successor"), (F.col("_at") - 1).alias("_at"))
        return rows.join(below, "_at", "left").join(above, "_at", "left").drop("_at")
    w = Window.partitionBy(*by).orderBy(value)
    return df.select(*by, value).distinct().select(*by, value, F.lag(value).over(w).alias("predecessor"), F.lead(value).over(w).alias("successor"))


def bounds(df: DataFrame, value: str, wanted: list) -> DataFrame:
    """For each wanted value the number of rows below it and of those at or below it (lower and upper bound); one pass."""
    row = df.agg(*(F.count_if(F.col(value) < w).alias(f"l{i}") for i, w in enumerate(wanted)), *(F.count_if(F.col(value) <= w).alias(f"u{i}") for i, w in enumerate(wanted)))
    items = F.array(*(F.struct(F.lit(w).alias("wanted"), F.col(f"l{i}").alias("lower"), F.col(f"u{i}").alias("upper")) for i, w in enumerate(wanted)))
    return row.select(F.explode(items).alias("x")).select("x.*")


def range_rows(df: DataFrame, value: str, lo, hi, inclusive: bool = True) -> DataFrame:
    """Rows from lo to hi; the filter reaches the scan."""
    x = F.col(value)
    return df.where((x >= lo) & ((x <= hi) if inclusive else (x < hi)))


#: Pairs that one task compares, and rows of a side in one block of a crowded cell (a merge join keeps up to 4,096 in plain memory).
PAIRS, BLOCK = 20_000_000, 2048


def overlaps(left: DataFrame, right: DataFrame, left_lo: str, left_hi: str, right_lo: str, right_hi: str, width: float) -> DataFrame:
    """Pairs of closed intervals that meet. Intervals are dealt to cells of the given width; a pair is given in its first common cell only.

    If there is more to compare than one task's share, both sides of a cell are dealt to blocks, and every two blocks meet in a task.
    """

    def cells(df: DataFrame, lo: str, hi: str, side: str) -> DataFrame:
        first = F.floor(F.col(lo) / width)
        return df.withColumn(f"_first_{side}", first).withColumn(f"_cell_{side}", F.explode(F.sequence(first, F.floor(F.col(hi) / width))))

    a, b = cells(left, left_lo, left_hi, "a"), cells(right, right_lo, right_hi, "b")
    same = F.col("_cell_a") == F.col("_cell_b")
    both = a.groupBy(F.col("_cell_a").alias("_cell")).agg(F.count("*").alias("_na")).join(b.groupBy(F.col("_cell_b").alias("_cell")).agg(F.count("*").alias("_nb")), "_cell")
    work = both.agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0
    if work > PAIRS:
        crowded = both.where((F.col("_na") > BLOCK) | (F.col("_nb") > BLOCK))  # one of BLOCK rows at most
        blocks, tasks = F.broadcast(cut(crowded.select("_cell", *(F.ceil(F.col(f"_n{s}") / BLOCK).alias(f"_n{s}") for s in "ab")))), int(-(-work // PAIRS))

        def dealt(df: DataFrame, own: str, other: str, columns: list[str]) -> DataFrame:
            rows = df.join(blocks, F.col(f"_cell_{own}") == F.col("_cell"), "left").fillna(1, ["_na", "_nb"]).withColumn(f"_{own}_{own}", F.pmod(F.xxhash64(*columns), f"_n{own}"))
            rows = rows.withColumn(f"_{other}_{own}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1))).drop("_cell", "_na", "_nb")
            return rows.repartition(tasks, f"_cell_{own}", f"_a_{own}", f"_b_{own}")

        a, b = dealt(a, "a", "b", left.columns).hint("merge"), dealt(b, "b", "a", right.columns)
        same = same & (F.col("_a_a") == F.col("_a_b")) & (F.col("_b_a") == F.col("_b_b"))
    meet = (F.col(left_lo) <= F.col(right_hi)) & (F.col(right_lo) <= F.col(left_hi)) & (F.col("_cell_a") == F.greatest("_first_a", "_first_b"))
    return a.join(b, same).where(meet).select(*left.columns, *right.columns)


def stab(df: DataFrame, lo: str, hi: str, point) -> DataFrame:
    return df.where((F.col(lo) <= point) & (F.col(hi) >= point))


def _cell(x: str, y: str, size: float) -> list[Column]:
    return [F.floor(F.col(x) / size), F.floor(F.col(y) / size)]


def within_radius(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float) -> DataFrame:
    """Pairs of points at most ``radius`` apart, through a grid of that size: each right point is looked for in nine cells."""
    a = left.withColumn("_i", F.floor(F.col(lx) / radius)).withColumn("_j", F.floor(F.col(ly) / radius))
    moves = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = right.withColumn("_m", F.explode(moves)).withColumn("_p", F.floor(F.col(rx) / radius) + F.col("_m.di")).withColumn("_q", F.floor(F.col(ry) / radius) + F.col("_m.dj"))
    d2 = F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2)
    return a.join(b, (F.col("_i") == F.col("_p")) & (F.col("_j") == F.col("_q"))).withColumn("distance", F.sqrt(d2)).where(d2 <= radius * radius).drop("_i", "_j", "_m", "_p", "_q")


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    return df.where((F.col(x) >= box[0]) & (F.col(x) <= box[2]) & (F.col(y) >= box[1]) & (F.col(y) <= box[3]))


def nearest_rows(df: DataFrame, distance: Column, k: int, tie: str) -> DataFrame:
    """The k rows at the least distance, the smallest ``tie`` first among equals."""
    return df.withColumn("distance", distance).orderBy("distance", tie).limit(k)


def closest_pair(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The closest two points of different keys; ties by the lesser key, then the greater.

    Points at one place are found by grouping. If there are none, a grid whose cells hold about one point bounds the distance
    first, then one radius join finds the pair; neither side of it is broadcast.
    """
    rows = df.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 2:
        raise ValueError("two points at least")
    spots = rows.groupBy("x", "y").agg(F.min("k").alias("a"), F.max("k").alias("z"))
    if (least := spots.where("a < z").agg(F.min("a")).first()[0]) is not None:
        met = rows.hint("merge").join(spots.where((F.col("a") == least) & (F.col("z") > least)).select("x", "y", "a"), ["x", "y"]).where("k > a")
        return met.groupBy("a").agg(F.min("k").alias("b")).withColumn("distance", F.lit(0.0))
    w = Window.partitionBy(F.floor((F.col("y") - y0) / max((y1 - y0) / max(n**0.5, 1), 1e-9))).orderBy("x", "y", "a")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    near = spots.select(F.when(F.col("a") != F.lag("a").over(w), step).alias("d")).agg(F.min("d")).first()[0]
    # a little more than the distance, which squared again may come out below its square; cells whose numbers doubles tell apart
    radius = max(near * (1 + 1e-9) if near is not None else max(x1 - x0, y1 - y0) * 1.5, max(map(abs, (x0, x1, y0, y1))) * 1e-12, 1e-150)
    a = spots.select("a", F.col("x").alias("ax"), F.col("y").alias("ay")).hint("merge")
    b = spots.select(F.col("a").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return within_radius(a, b, "ax", "ay", "bx", "by", radius).where("a < b").orderBy("distance", "a", "b").limit(1).select("a", "b", "distance")


def k_nearest(queries: DataFrame, points: DataFrame, query_key: str, point_key: str, query_vector: str, point_vector: str, k: int, most_queries: int = 10_000) -> DataFrame:
    """Exact k nearest by Euclidean distance for a bounded set of queries, which is checked and broadcast; ties by key.

    Each task keeps its own k best per query before anything is shuffled.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    q = F.broadcast(queries.select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("_q")))
    d = F.sqrt(F.aggregate(F.zip_with(F.col("_q"), F.col("_p"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    p = points.select(F.col(point_key).alias("point"), F.col(point_vector).cast("array<double>").alias("_p"), *(c for c in points.columns if c not in (point_key, point_vector)))
    pairs = p.join(q).withColumn("distance", d).drop("_q", "_p")
    w = Window.partitionBy("query").orderBy("distance", "point")
    return pairs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def ring_lookup(keys: DataFrame, nodes: list[str], key_hash: Column, replicas: int = 16) -> DataFrame:
    """Consistent hashing: the first virtual node at or after the key's hash, the first of all beyond the last.

    Virtual nodes are few: they are a literal array of the plan. Hashes are 60 bits of MD5.
    """
    import hashlib

    ring = sorted((int(hashlib.md5(f"{n}#{r}".encode()).hexdigest()[:15], 16), n) for n in nodes for r in range(replicas))
    table = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(n).alias("node")) for h, n in ring))
    return keys.withColumn("_h", key_hash).withColumn("node", F.coalesce(F.get(F.filter(table, lambda v: v["h"] >= F.col("_h")), F.lit(0))["node"], F.lit(ring[0][1]))).drop("_h")


def rank_in_set(df: DataFrame, score: str, member: str, by: Cols = (), out: str = "rank") -> DataFrame:
    """Rank from 0 by (score, member), as in a sorted set."""
    return enumerate_rows(df, [score, member], by, out=out)


def range_aggregate(df: DataFrame, pos: str, value: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """sum, min, max over each closed range of positions, all in one pass."""
    rows = df.select(F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(ranges))), lambda r: (F.col(pos) >= r["lo"]) & (F.col(pos) <= r["hi"]))).alias("r"), F.col(value).alias("v"))
    return rows.groupBy(F.col("r.id").alias("range")).agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))


def range_update(df: DataFrame, pos: str, value: str, updates: list[tuple[int, int, float]]) -> DataFrame:
    """Every value plus the updates (lo, hi, add) whose range holds its position."""
    total = F.lit(0.0)
    for lo, hi, add in updates:
        total = total + F.when((F.col(pos) >= lo) & (F.col(pos) <= hi), add).otherwise(0.0)
    return df.withColumn(value, F.col(value) + total)


def upsert(base: DataFrame, changes: DataFrame, key: Cols) -> DataFrame:
    """An ordered map's inserts: changed keys take their new row, others keep theirs."""
    return base.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def remove(base: DataFrame, keys: DataFrame, key: Cols) -> DataFrame:
    return base.join(keys.select(*key).distinct(), list(key), "left_anti")


# Spatial shapes over ordered points
def polygon_measures(df: DataFrame, x: str, y: str, order_by: Cols, by: Cols) -> DataFrame:
    """Signed area (positive if counter-clockwise), perimeter and centroid of each closed polygon."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_nx", F.coalesce(F.lead(x).over(w), F.first(x).over(whole))).withColumn("_ny", F.coalesce(F.lead(y).over(w), F.first(y).over(whole)))
    c = F.col(x) * F.col("_ny") - F.col("_nx") * F.col(y)
    g = rows.groupBy(*by).agg((F.sum(c) / 2).alias("area"), F.sum(F.sqrt(F.pow(F.col(x) - F.col("_nx"), 2) + F.pow(F.col(y) - F.col("_ny"), 2))).alias("perimeter"), F.sum((F.col(x) + F.col("_nx")) * c).alias("_cx"), F.sum((F.col(y) + F.col("_ny")) * c).alias("_cy"))
    six = F.when(F.col("area") != 0, 6 * F.col("area"))
    return g.select(*by, "area", "perimeter", (F.col("_cx") / six).alias("cx"), (F.col("_cy") / six).alias("cy"))


def in_polygon(df: DataFrame, x: str, y: str, polygon: list[tuple[float, float]], out: str = "inside") -> DataFrame:
    """Even-odd rule; the polygon is part of the expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            crossings = crossings + F.when(((F.col(y) < y1) != (F.col(y) < y2)) & (F.col(x) < x1 + (F.col(y) - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0)
    return df.withColumn(out, crossings % 2 == 1)


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the leftmost point, without points on its edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(rows):
        out = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def convex_hull(df: DataFrame, x: str, y: str, by: Cols = ()) -> DataFrame:
    """Vertices of the hull of each group. Every task keeps the hull of its own share, and hulls of hulls are joined."""
    import pandas as pd

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "nth int, x double, y double"])

    def share(batches):
        for pdf in batches:
            groups = pdf.groupby(list(by), dropna=False) if by else [((), pdf)]
            for k, g in groups:
                h = hull_of(list(zip(g["_x"], g["_y"])))
                yield pd.DataFrame([(*(k if isinstance(k, tuple) else (k,)), i, *p) for i, p in enumerate(h)], columns=[*by, "nth", "x", "y"])

    def whole(k, g):
        return pd.DataFrame([(*k, i, *p) for i, p in enumerate(hull_of(list(zip(g["x"], g["y"]))))], columns=[*by, "nth", "x", "y"])

    small = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).mapInPandas(share, schema)
    return small.groupBy(*by).applyInPandas(whole, schema) if by else small.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda k, g: whole((), g), schema)
