"""What failed on larger tables: statistics, kernels and graphs against plain versions."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import kernels as kn
from millrace.operators import graph, hypothesis_tests, lookup, statistics


def test_anderson_darling_far_from_normal(spark):
    uniform = spark.range(100_000).withColumn("x", F.col("id").cast("double"))
    r = hypothesis_tests.anderson_darling(uniform, "x").first()
    assert r.statistic > 600 and 0 <= r.p_value < 1e-6
    r = hypothesis_tests.anderson_darling(spark.range(50).withColumn("x", F.lit(3.0)), "x").first()
    assert (r.statistic, r.p_value) == (0.0, 1.0)


def test_shapiro_wilk_of_many_values(spark):
    rows = spark.range(7000).select(F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 7 == 0, None).otherwise(F.sqrt("id")).alias("x"))
    v = np.array(sorted(r.x for r in rows.collect() if r.x is not None))
    z = hypothesis_tests._NORMAL.quantile((np.arange(1, len(v) + 1) - 0.375) / (len(v) + 0.25))
    w = (z @ v) ** 2 / (len(v) * ((v - v.mean()) ** 2).sum())
    r = hypothesis_tests.shapiro_wilk(rows, "x").first()
    assert len(v) > 5000 and r.statistic == pytest.approx(w, abs=1e-9)
    assert r.p_value == pytest.approx(math.erfc((1 - w) * math.sqrt(len(v)) / math.sqrt(2)), abs=1e-6)
    assert tuple(hypothesis_tests.shapiro_wilk(spark.range(5).select(F.lit(2).alias("x")), "x").first())[:2] == (1.0, 1.0)


def test_kernels_of_long_arrays():
    rng = random.Random(5)

    def plain_bitonic(a):
        def rising(a):
            out = []
            for i, x in enumerate(a):
                out.append(1 + max((out[j] for j in range(i) if a[j] < x), default=0))
            return out

        return max((u + d - 1 for u, d in zip(rising(a), rising(a[::-1])[::-1])), default=0)

    def plain_bins(sizes, capacity):
        rooms = []
        for s in sorted(sizes, reverse=True):
            i = next((i for i, r in enumerate(rooms) if r >= s), None)
            if i is None:
                rooms.append(capacity - s)
            else:
                rooms[i] -= s
        return len(rooms)

    for n in [*range(9), *(rng.randrange(60) for _ in range(200))]:
        a = [rng.randrange(70) for _ in range(n)]
        assert kn.bitonic(a) == plain_bitonic(a)
        assert kn.first_fit_decreasing(a, 60) == plain_bins(a, 60)
    a = [rng.randrange(1, 51) for _ in range(48_000)]
    began = time.process_time()
    assert kn.bitonic(a) > 80 and kn.first_fit_decreasing(a, 60) > 15_000
    assert time.process_time() - began < 20


def test_kendall_of_many_rows(spark):
    rng = random.Random(7)
    for n, most, keys in ((0, 5, 9), (1, 5, 9), (60, 4, 1000), (400, 30, 150), (400, 1000, 10**9)):
        rows = [(rng.randrange(keys), rng.randrange(most), rng.choice([None, *map(float, range(most))])) for _ in range(n)]
        got = statistics.kendall(spark.createDataFrame(rows, "k long, x long, y double").repartition(5), "x", "y", "k").first()
        pairs = [(b[1] - a[1], b[2] - a[2]) for a in rows for b in rows if a[0] < b[0] and a[2] is not None and b[2] is not None]
        up, down = sum(p * q > 0 for p, q in pairs), sum(p * q < 0 for p, q in pairs)
        size = math.sqrt((up + down + sum(p == 0 != q for p, q in pairs)) * (up + down + sum(q == 0 != p for p, q in pairs)))
        assert tuple(got) == (up, down, pytest.approx((up - down) / size if size else 0.0))
    n = 30_000
    rows = spark.range(n).select("id", (F.col("id") * 7 % n).alias("x"), (F.col("id") * 11 % n).alias("y"))
    x, y = (np.arange(n) * 7 % n, np.arange(n) * 11 % n)
    up = sum(int(((x[i] - x[:i]) * (y[i] - y[:i]) > 0).sum()) for i in range(n))
    assert tuple(statistics.kendall(rows, "x", "y", "id").first())[:2] == (up, n * (n - 1) // 2 - up)


def test_kendall_over_several_shares(spark):
    counts = spark.createDataFrame([(i % 50, i * 37 % 101, 1 + i % 3) for i in range(5000)], "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = statistics._discordant(counts)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    x, y, w = (np.array([r[c] for r in rows]) for c in ("x", "y", "n"))
    assert got == sum(int((w[i] * w[(x < x[i]) & (y > y[i])]).sum()) for i in range(len(rows)))


def test_closest_pair_lists_and_broadcasts_no_points(spark):
    rng = random.Random(9)
    for n, most, keys in ((2, 9, 99), (40, 4, 1000), (40, 1000, 1000), (60, 10**6, 30), (300, 10**6, 10**9)):
        rows = [(rng.randrange(keys), float(rng.randrange(most)), rng.randrange(most) / 7) for _ in range(n)]
        pairs = [(math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), a[0], b[0]) for a in rows for b in rows if a[0] < b[0]]
        got = lookup.closest_pair(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y").collect()
        assert [(r.distance, r.a, r.b) for r in got] == [min(pairs)]
    for rows in ([(1, 0.0, 0.0), (2, 1.0, math.sqrt(2))], [(1, 0.0, 0.0), (2, 0.1, 0.7), (3, 50.0, 50.0)]):
        assert [(r.a, r.b) for r in lookup.closest_pair(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y").collect()] == [(1, 2)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    apart = spark.range(500).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert "Broadcast" not in plan(lookup.closest_pair(apart, "id", "x", "y"))
    copies = spark.range(20_000).select("id", (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    found = lookup.closest_pair(copies, "id", "x", "y")
    assert tuple(found.first()) == (0, 2, 0.0) and "power" not in plan(found).lower() and "Broadcast" not in plan(found)


def _parts(vertices, edges):
    up = {v: v for v in vertices}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    return sum(up[v] == v for v in vertices)


def _weak(edges):
    vertices = {v for e in edges for v in e}
    n = _parts(vertices, edges)
    bridges = [(min(e), max(e), "bridge") for i, e in enumerate(edges) if _parts(vertices, edges[:i] + edges[i + 1 :]) > n]
    cuts = [(v, v, "cut") for v in vertices if _parts(vertices - {v}, [e for e in edges if v not in e]) > n]
    return sorted(bridges + cuts)


def test_weak_points_of_forests_are_those_of_the_graph():
    import pandas as pd

    rng = random.Random(11)
    for _ in range(400):
        n = rng.randrange(2, 12)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 26))]
        count = {}
        for a, b in edges:
            if a != b:
                count[min(a, b), max(a, b)] = count.get((min(a, b), max(a, b)), 0) + 1
        pdf = pd.DataFrame([(*e, c > 1) for e, c in count.items()], columns=["u", "v", "twice"]).astype({"u": "int64", "v": "int64", "twice": "bool"})
        walk = lambda f: sorted(r for x in graph._low_points([f]) for r in x.itertuples(index=False, name=None))
        assert walk(pdf) == _weak(edges)
        shares = [x for k in range(3) for x in graph._two_forests([pdf[pdf.index % 3 == k].reset_index(drop=True)])]
        if shares:
            less = pd.concat(shares)
            assert len(less) <= len(pdf) and walk(less) == _weak(edges)


def test_bridges_of_more_than_a_million_edges(spark):
    n = 600_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    spokes = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + n).alias("dst"))
    chord = spark.createDataFrame([(n, 2 * n), (n, 2 * n), (3 * n, 3 * n), (None, 1), (0, n)], "src long, dst long")
    e = ring.union(spokes).union(chord)
    assert graph.bridges(e).agg(F.count("*"), F.min("src"), F.max("dst")).first() == (n - 1, 1, 2 * n - 1)
    assert graph.cut_vertices(e).agg(F.count("*"), F.min("id"), F.max("id")).first() == (n + 1, 0, n)


def test_overlaps_of_crowded_cells(spark, monkeypatch):
    rng = random.Random(13)
    sides = [[(i, lo := rng.randrange(200) / 2, lo + rng.randrange(30)) for i in range(150)] for _ in range(2)]
    expected = sorted((a[0], b[0]) for a in sides[0] for b in sides[1] if a[1] <= b[2] and b[1] <= a[2])
    a, b = (spark.createDataFrame(rows, f"{k} long, {k}lo double, {k}hi double") for k, rows in zip("ab", sides))
    whole = lookup.overlaps(a, b, "alo", "ahi", "blo", "bhi", 20.0)
    assert whole.columns == ["a", "alo", "ahi", "b", "blo", "bhi"]
    assert sorted((r.a, r.b) for r in whole.collect()) == expected
    monkeypatch.setattr(lookup, "PAIRS", 500)
    monkeypatch.setattr(lookup, "BLOCK", 7)
    assert sorted((r.a, r.b) for r in lookup.overlaps(a, b, "alo", "ahi", "blo", "bhi", 20.0).collect()) == expected
    monkeypatch.undo()
    n = 6000
    a, b = (spark.range(0, n, 1, 1).select(F.col("id").alias(k), F.lit(0.0).alias(f"{k}lo"), F.lit(1.0).alias(f"{k}hi")) for k in "ab")
    crowded = lookup.overlaps(a, b, "alo", "ahi", "blo", "bhi", 20.0)
    assert crowded.rdd.getNumPartitions() > 1 and crowded.count() == n * n
