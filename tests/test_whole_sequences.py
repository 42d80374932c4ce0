"""Operators on whole tables, and joins by similarity, against plain versions on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, lookup, sequence, signal, sketch, statistics


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, rng.choice("aab"), None if rng.random() < 0.1 else rng.choice([-2.0, 0.5, 1.5, 3.0, 0.0 if i > 30 else 1.0])) for i in range(60)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "i long, kind string, x double").repartition(5)


def test_runs_of_a_whole_table(df, rows):
    want, last = [], object()
    for _, kind, _ in rows:
        if kind != last:
            want.append([kind, 0])
        want[-1][1] += 1
        last = kind
    got = sequence.run_lengths(df, "kind", ["i"]).collect()
    assert sorted((r.run, r.kind, r.length) for r in got) == [(k, *w) for k, w in enumerate(want)]
    plan = sequence.run_lengths(df, "kind", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


def test_as_of_over_a_whole_table(spark):
    rng = random.Random(6)
    left = [(k, rng.randrange(200)) for k in range(80)]
    right = [(k, rng.randrange(20, 200), None if k % 9 == 0 else k * 10) for k in range(50)]
    l = spark.createDataFrame(left, "id long, t long").repartition(4)
    r = spark.createDataFrame(right, "rid long, at long, v long").repartition(3)
    got = {x.id: x.value for x in lookup.as_of(l, r, "t", "at", F.col("v"), "rid").collect()}
    for k, t in left:
        seen = sorted((at, rid, v) for rid, at, v in right if at <= t and v is not None)
        assert got[k] == (seen[-1][2] if seen else None)


def test_running_product_with_signs_zeros_and_nulls(df, rows):
    got = {r.i: r.product for r in sequence.running_product(df.withColumn("one", F.lit(1)), "x", ["i"], ["one"]).collect()}
    product = 1.0
    for i, _, x in rows:
        product *= 1.0 if x is None else x
        assert got[i] == pytest.approx(product)


def test_upper_median_and_exponential_average(df, rows):
    got = {r.kind: r.median for r in sequence.upper_median(df, "x", ["kind"]).collect()}
    averages = {r.i: r.ema for r in statistics.exponential_average(df, "x", 3, ["i"], ["kind"]).collect()}
    for kind in "ab":
        values = sorted(x for _, k, x in rows if k == kind and x is not None)
        assert got[kind] == values[len(values) // 2]
        y = None
        for i, k, x in rows:
            if k == kind:
                y = (x or 0.0) if y is None else 0.5 * (x or 0.0) + 0.5 * y
                assert averages[i] == pytest.approx(y)


@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
def test_jaccard_against_all_pairs(spark, least):
    rng = random.Random(7)
    sets = {k: set(rng.sample(range(30), rng.randint(1, 6))) | ({99} if k % 2 else set()) for k in range(60)}
    sets[60], sets[61] = set(sets[3]), set(sets[3])
    df = spark.createDataFrame([(k, w) for k, s in sets.items() for w in s] * 2, "k long, w long").repartition(4)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    got = {(r.a, r.b): r.jaccard for r in sketch.exact_jaccard(df, "k", "w", least).collect()}
    assert got == pytest.approx({p: s for p, s in want.items() if s >= least})


def test_correlation_by_lags(spark):
    a, b = [1.0, 2.0, -1.0, 0.5], [3.0, 0.0, 2.0, 1.0]
    left, right = (spark.createDataFrame(list(enumerate(v)), "pos long, x double") for v in (a, b))
    got = {r.pos: r.x for r in signal.correlate(left, right, 2).collect()}
    assert got == pytest.approx({k: sum(a[i] * b[i + k] for i in range(4 - k)) for k in range(3)})


def test_components_against_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    group = {v: {v} for e in edges for v in e}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: min(g) for v, g in group.items()}
