"""Walks, matchings, solvers, posteriors and optimisers against plain versions."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, hypothesis_tests, learning, linalg


def test_depth_first_order(spark):
    rng = random.Random(2)
    for _ in range(30):
        rows = [(a, b, 1.0) for a in range(7) for b in range(7) if a != b and rng.random() < 0.2]
        near = {v: sorted({b for a, b, _ in rows if a == v}) for v in sorted({x for r in rows for x in r[:2]})}
        seen, done, clock = {}, {}, 0

        def go(v, parent):
            nonlocal clock
            seen[v], clock = (parent, clock), clock + 1
            for u in near[v]:
                if u not in seen:
                    go(u, v)
            done[v], clock = clock, clock + 1

        for v in near:
            if v not in seen:
                go(v, None)
        got, cycle = graph.depth_first_of(rows)
        assert got == [(v, *seen[v], done[v]) for v in near]
        reach = {(a, b) for a, b, _ in rows}
        for _ in range(7):
            reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
        assert cycle == any((v, v) in reach for v in near)
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (5, 1)], "src long, dst long")
    assert sorted(map(tuple, graph.depth_first(edges).collect())) == [(1, None, 0, 7), (2, 1, 1, 4), (3, 1, 5, 6), (4, 2, 2, 3), (5, None, 8, 9)]
    assert not graph.has_cycle(edges) and graph.has_cycle(edges.union(spark.createDataFrame([(4, 1)], "src long, dst long")))
    colours = {r.id: r.colour for r in graph.exact_colours(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)], "src long, dst long")).collect()}
    assert len(set(colours.values())) == 3


def test_matching_is_largest_and_needs_no_stack():
    rng = random.Random(3)
    for _ in range(60):
        rows = sorted({(a, 10 + b, 1.0) for a in range(5) for b in range(5) if rng.random() < 0.35})
        got = graph.matching_of(rows)
        assert {(a, b) for a, b in got} <= {(a, b) for a, b, _ in rows} and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        has = {(a, b) for a, b, _ in rows}
        assert len(got) == max(sum((a, 10 + p[a]) in has for a in range(5)) for p in permutations(range(5)))
    chain = sorted([(i, i, 1.0) for i in range(30000)] + [(i, i - 1, 1.0) for i in range(1, 30000)])
    assert len(graph.matching_of(chain)) == 30000


def test_a_star():
    rng = random.Random(4)
    points = {v: (rng.random(), rng.random()) for v in range(30)}
    apart = lambda a, b: math.dist(points[a], points[b])
    rows = [(a, b, apart(a, b)) for a in points for b in points if a != b and apart(a, b) < 0.35]
    length, path = graph.a_star_of(rows, 0, 7, lambda v: apart(v, 7))
    best = {v: math.inf for v in points} | {0: 0.0}
    for _ in points:
        for a, b, w in rows:
            best[b] = min(best[b], best[a] + w)
    assert length == pytest.approx(best[7]) and path[0] == 0 and path[-1] == 7
    assert graph.a_star_of([(1, 2, 1.0)], 2, 1, lambda v: 0.0) is None


def test_solvers_of_general_systems(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(6, 6)) + 6 * np.eye(6)
    b = np.arange(1.0, 7.0)
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "i long, j long, v double")
    scale = linalg.inverse_diagonal(coo, 6)
    assert np.allclose(scale, 1 / np.diag(a))
    assert np.allclose(linalg.stabilised_gradients(coo, b), np.linalg.solve(a, b), atol=1e-6)
    assert np.allclose(linalg.minimal_residual(coo, b, preconditioner=scale), np.linalg.solve(a, b), atol=1e-6)


def test_intervals_and_evidence(spark):
    df = spark.createDataFrame([(3.0, 9.0), (20.0, 1.5)], "a double, b double")
    for r in df.select("a", "b", hypothesis_tests.beta_interval(F.col("a"), F.col("b"), 0.9).alias("beta"), hypothesis_tests.gamma_interval(F.col("a"), F.col("b"), 0.9).alias("gamma"), hypothesis_tests.normal_interval(F.col("a"), F.col("b"), 0.9).alias("normal")).collect():
        x = np.linspace(0, 1, 200001)[1:-1]
        for i, x, log in ((r.beta, x, lambda x: (r.a - 1) * np.log(x) + (r.b - 1) * np.log1p(-x)), (r.gamma, np.linspace(0, 60, 400001)[1:], lambda x: (r.a - 1) * np.log(x) - r.b * x), (r.normal, np.linspace(-20, 40, 400001), lambda x: -((x - r.a) ** 2) / 2 / r.b)):
            p = np.exp(log(x) - log(x).max())
            share = np.cumsum(p) / p.sum()
            assert np.interp(i.lo, x, share) == pytest.approx(0.05, abs=1e-4) and np.interp(i.hi, x, share) == pytest.approx(0.95, abs=1e-4)
    k, n = 4, 10
    p = (np.arange(100000) + 0.5) / 100000
    prior = p * (1 - p) ** 7 / (p * (1 - p) ** 7).mean()
    want = math.log((math.comb(n, k) * p**k * (1 - p) ** (n - k) * prior).mean())
    got = spark.createDataFrame([(k, n)], "k long, n long").select(hypothesis_tests.log_evidence(F.col("k"), F.col("n"), 2.0, 8.0)).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_optimisers_find_the_bottom():
    centre = np.array([1.0, -2.0, 0.5])
    for step, settings, rounds in ((learning.rectified_adam_step, {"rate": 0.02}, 3000), (learning.lars_step, {"trust": 0.02, "rate": 0.5}, 3000), (learning.lamb_step, {"rate": 0.002}, 6000), (learning.lookahead_step, {"step": learning.sgd_step, "rate": 0.05}, 500)):
        w, state = np.array([3.0, 3.0, 3.0]), {}
        for _ in range(rounds):
            w = step(w, 2 * (w - centre), state, **settings)
        assert np.linalg.norm(w - centre) < 0.1, step
