"""Kernels and distributions against published values and brute force."""

import math
import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import distributions as d
from millrace.functions import kernels as kn
from millrace.functions import maths as mt
from millrace.functions import special
from millrace.functions import text as tx
from millrace.operators import graph, learning, linalg, signal


@pytest.mark.parametrize(("dist", "x", "cdf"), [
    (d.Normal(), 1.96, 0.9750021), (d.StudentT(10), 2.228139, 0.975), (d.ChiSquared(5), 11.0705, 0.95), (d.FDist(3, 20), 3.098391, 0.95), (d.Gamma(2, 1), 1.0, 1 - 2 / math.e),
    (d.Beta(2, 3), 0.5, 0.6875), (d.Exponential(2), 0.5, 1 - 1 / math.e), (d.Binomial(10, 0.5), 5, 0.623046875), (d.Poisson(3), 2, 0.4231901), (d.Geometric(0.25), 2, 1 - 0.75**3),
])
def test_distribution_functions(dist, x, cdf):
    got = float(np.atleast_1d(dist.cdf(np.array([x])))[0])
    assert got == pytest.approx(cdf, abs=2e-6)
    assert float(np.atleast_1d(dist.quantile(np.array([got - 1e-12])))[0]) == pytest.approx(x, abs=1e-3)


def test_special_functions():
    assert special.bessel_j(0, 1.0)[0] == pytest.approx(0.7651976866, abs=1e-8)
    assert special.bessel_y(0, 1.0)[0] == pytest.approx(0.0882569642, abs=1e-5)
    assert float(special.beta(2, 3)) == pytest.approx(1 / 12)


def test_text_kernels():
    assert tx.jaro_of("MARTHA", "MARHTA") == pytest.approx(0.9444, abs=1e-4)
    assert tx.jaro_of("DIXON", "DICKSONX") == pytest.approx(0.7667, abs=1e-4)
    assert tx.jaro_of("", "") == 1.0 and tx.jaro_of("", "a") == 0.0
    assert tx.osa_of("ca", "abc") == 3 and tx.osa_of("ab", "ba") == 1
    assert tx.longest_palindrome_of("babad") == "bab" and tx.longest_palindrome_of("") == ""
    assert tx.longest_repeat_of("banana") == "ana" and tx.distinct_substrings_of("banana") == 15
    assert tx.z_array_of("aabaab") == [0, 1, 0, 3, 1, 0]
    for s in ("", "abababab", "TOBEORNOTTOBEORTOBEORNOT", "héé"):
        assert tx.lzw_decode_of(tx.lzw_encode_of(s)) == s
    random.seed(1)
    for _ in range(100):
        s = "".join(random.choice("ab") for _ in range(random.randint(0, 12)))
        assert tx.suffix_array_of(s) == sorted(range(len(s)), key=lambda i: s[i:])
        best = max((s[i:j] for i in range(len(s)) for j in range(i, len(s) + 1) if s[i:j] == s[i:j][::-1]), key=len, default="")
        assert len(tx.longest_palindrome_of(s)) == len(best)


def test_soundex_and_globs(spark):
    golden = {"Robert": "R163", "Rubin": "R150", "Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555"}
    rows = spark.createDataFrame([(k,) for k in golden], "s string").select("s", tx.soundex(F.col("s"))).collect()
    assert dict(map(tuple, rows)) == golden
    cases = [("*.py", "a.py", True), ("a?c", "abc", True), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a\\*b", "a*b", True), ("a[b", "a[b", True), ("*", "", True), ("a.c", "abc", False)]
    for glob, s, want in cases:
        assert spark.range(1).select(tx.glob_match(F.lit(s), glob)).first()[0] is want, glob


def test_number_kernels():
    assert [n for n in range(60) if mt.is_prime_of(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert mt.is_prime_of(2**61 - 1) and not mt.is_prime_of(2**61 + 1)
    assert mt.crt_of([2, 3, 2], [3, 5, 7]) == 23 and mt.crt_of([1, 2], [4, 6]) is None
    assert mt.catalan_of(5) == 42 and mt.partitions_of(10) == 42 and mt.stirling_second_of(5, 2) == 15 and mt.stirling_first_of(5, 2) == 50 and mt.tableaux_of([3, 2]) == 5
    assert mt.fibonacci_of(50) == 12586269025 and mt.totient_of(36) == 12


def test_geography(spark):
    km, hash_, deg = spark.range(1).select(mt.haversine(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278)), mt.geohash(F.lit(57.64911), F.lit(10.40744), 11), mt.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert 5500 < km < 5600 and hash_ == "u4pruydqqvj" and deg == pytest.approx(90)


def test_dynamic_programs():
    random.seed(2)
    for _ in range(60):
        a = [random.randint(0, 9) for _ in range(random.randint(1, 7))]
        rising = max(len(c) for n in range(len(a) + 1) for c in combinations(a, n) if all(x < y for x, y in zip(c, c[1:])))
        assert kn.lis(a) == rising
        assert kn.house_robber(a) == max(sum(a[i] for i in c) for n in range(len(a) + 1) for c in combinations(range(len(a)), n) if all(y - x > 1 for x, y in zip(c, c[1:])))
        assert kn.knapsack(a, a, 12) == max(sum(c) for n in range(len(a) + 1) for c in combinations(a, n) if sum(c) <= 12)
        order = sorted(set(permutations(a)))
        nxt = order[(order.index(tuple(a)) + 1) % len(order)]
        assert tuple(kn.next_permutation(a)) == nxt
    assert kn.coin_min([1, 2, 5], 11) == 3 and kn.coin_min([2], 3) == -1 and kn.coin_ways([1, 2, 5], 5) == 4
    assert kn.matrix_chain((40, 20, 30, 10, 30)) == 26000 and kn.burst_balloons([3, 1, 5, 8]) == 167 and kn.egg_drop(2, 10) == 4
    assert kn.decode_ways("226") == 3 and kn.decode_ways("06") == 0 and kn.min_jumps([2, 3, 1, 1, 4]) == 2 and not kn.jump_game([3, 2, 1, 0, 4])
    assert kn.palindrome_cuts("aab") == 1 and kn.palindromic_subsequence("bbbab") == 4 and kn.valid_parentheses(")()())") == 4
    assert kn.distinct_subsequences("rabbbit", "rabbit") == 3 and kn.word_break("leetcode", ["leet", "code"]) and kn.n_queens(6) == 4
    assert kn.cache_hits([1, 2, 3, 1, 2, 3], 2) == 0 and kn.cache_hits([1, 2, 1, 3, 1], 2) == 2 and kn.cache_hits([1, 1, 2, 3, 1], 2, "lfu") == 2
    board = [[5, 3, 0, 0, 7, 0, 0, 0, 0], [6, 0, 0, 1, 9, 5, 0, 0, 0], [0, 9, 8, 0, 0, 0, 0, 6, 0], [8, 0, 0, 0, 6, 0, 0, 0, 3], [4, 0, 0, 8, 0, 3, 0, 0, 1], [7, 0, 0, 0, 2, 0, 0, 0, 6], [0, 6, 0, 0, 0, 0, 2, 8, 0], [0, 0, 0, 4, 1, 9, 0, 0, 5], [0, 0, 0, 0, 8, 0, 0, 7, 9]]
    solved = kn.sudoku(board)
    assert all(sorted(r) == list(range(1, 10)) for r in solved) and all(sorted(c) == list(range(1, 10)) for c in zip(*solved))


def test_dense_algebra():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(6, 6)), rng.normal(size=6)
    order, low, up = linalg.lu(a)
    assert np.allclose(low @ up, a[order])
    assert np.allclose(linalg.solve(a, b), np.linalg.solve(a, b)) and np.allclose(linalg.solve(a @ a.T, b), np.linalg.solve(a @ a.T, b))
    with pytest.raises(ValueError):
        linalg.solve(a[:3], b[:3])
    total, rows = graph.assignment_of([[4, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert total == 5 and sorted(rows) == [0, 1, 2]


def test_iterative_solvers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 5))
    a = x @ x.T + 5 * np.eye(5)
    coo = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(5) for j in range(5)], "i long, j long, v double")
    assert np.allclose(linalg.conjugate_gradient(coo, np.arange(5.0)), np.linalg.solve(a, np.arange(5.0)), atol=1e-6)


def test_methods():
    assert signal.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(2**0.5) and signal.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0) == pytest.approx(2**0.5) and signal.secant(lambda x: x * x - 2, 1, 2) == pytest.approx(2**0.5)
    assert signal.quadrature(math.sin, 0, math.pi) == pytest.approx(2) and signal.gauss_legendre(math.exp, 0, 1) == pytest.approx(math.e - 1)
    assert signal.runge_kutta(lambda t, y: y, 0, 1.0, 1, 100)[1][-1][0] == pytest.approx(math.e)
    f, g = lambda v: (1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2, lambda v: np.array([-2 * (1 - v[0]) - 400 * v[0] * (v[1] - v[0] ** 2), 200 * (v[1] - v[0] ** 2)])
    assert np.allclose(signal.minimise(f, g, [-1.2, 1.0]), [1, 1], atol=1e-4) and np.allclose(signal.nelder_mead(f, [-1.2, 1.0]), [1, 1], atol=1e-3)
    assert np.allclose(signal.cubic_spline([0, 1, 2, 3], [0, 1, 2, 3], [0.5, 2.5]), [0.5, 2.5])
    for step in (learning.sgd_step, learning.rmsprop_step, learning.adam_step, learning.adagrad_step, learning.adadelta_step):
        w, state = np.array([1.0, -1.0]), {}
        for _ in range(300):
            w = step(w, 2 * w, state)
        assert np.abs(w).max() < 1.0
    assert learning.viterbi_of(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]]), [0, 1, 2]) == [0, 0, 1]
    assert learning.agglomerate_of(np.array([[0.0], [0.1], [5.0], [5.1]]), 2) == [0, 0, 1, 1]


def test_streams(spark, tmp_path):
    from millrace.streaming import events as ev

    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "c", 1)], "user long, page string, at long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = ev.running_cache(ev.stream(spark, str(tmp_path / "in"), rows.schema), "user", "page", "at", 2).writeStream.format("memory").queryName("hits").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("hits").collect()} == {(1, 1, 3), (2, 0, 1)}


def test_sources(spark, tmp_path):
    from millrace.sources import tables as tb

    assert [r.x for r in tb.arange(spark, 2, 10, 3).orderBy("pos").collect()] == [2, 5, 8]
    assert [r.x for r in tb.linspace(spark, 0.0, 1.0, 5).orderBy("pos").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    df = tb.full(spark, 3, 2.5)
    for kind in tb.FORMATS:
        tb.write(df, str(tmp_path / kind), kind)
        assert tb.read(spark, str(tmp_path / kind), kind, df.schema).count() == 3
    with pytest.raises(ValueError):
        tb.read(spark, "x", "csv")
