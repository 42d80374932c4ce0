"""Shapes, covers, codecs and small-sample learners against brute force."""

import math
import random
from itertools import permutations

import numpy as np
import pytest

from millrace.functions import shapes as sh
from millrace.operators import learning_kernels as lk


def test_shapes():
    rng = random.Random(1)
    points = [(rng.random() * 10, rng.random() * 10) for _ in range(25)]
    assert sh.diameter(points) == pytest.approx(max(math.dist(a, b) for a in points for b in points))
    for t in sh.delaunay(points):  # no point inside a triangle's circle
        a, b, c = (points[i] for i in t)
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        q = [x * x + y * y for x, y in (a, b, c)]
        o = ((q[0] * (b[1] - c[1]) + q[1] * (c[1] - a[1]) + q[2] * (a[1] - b[1])) / d, (q[0] * (c[0] - b[0]) + q[1] * (a[0] - c[0]) + q[2] * (b[0] - a[0])) / d)
        assert all(math.dist(o, p) >= math.dist(o, a) - 1e-6 for p in points)
    assert len(sh.voronoi_vertices(points)) == len(sh.delaunay(points))
    shape = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    area = sum(abs(sh.turn(*(shape[i] for i in t))) / 2 for t in sh.ear_clip(shape))
    assert area == pytest.approx(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(shape, shape[1:] + shape[:1]))) / 2)
    assert sh.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert sh.least_rectangle([(0, 0), (2, 0), (2, 1), (0, 1)]) == pytest.approx(2)


def test_tours_and_covers():
    rng = random.Random(2)
    points = [(rng.random(), rng.random()) for _ in range(8)]
    best = min(sh.tour_length(points, [0, *p]) for p in permutations(range(1, 8)))
    assert sorted(sh.nearest_tour(points)) == sorted(sh.tree_tour(points)) == list(range(8))
    assert best <= sh.tour_length(points, sh.tree_tour(points)) <= 2 * best + 1e-9
    assert sh.greedy_cover({1, 2, 3, 4}, [{1}, {1, 2, 3}, {3, 4}]) == [1, 2]
    edges = [(1, 2), (2, 3), (3, 4), (1, 4)]
    assert all(a in sh.vertex_cover(edges) or b in sh.vertex_cover(edges) for a, b in edges)
    assert sorted(sh.exact_cover([{1, 4}, {2, 3}, {1, 2}, {3, 4}], {1, 2, 3, 4})[0]) in ([0, 1], [2, 3])
    path = sh.knights_tour(6)
    assert len(set(path)) == 36 and all(sorted((abs(a[0] - b[0]), abs(a[1] - b[1]))) == [1, 2] for a, b in zip(path, path[1:]))
    assert sh.word_on_board(["ABCE", "SFCS", "ADEE"], "ABCCED") and not sh.word_on_board(["ABCE", "SFCS", "ADEE"], "ABCB")


def test_codecs():
    for data in (b"", b"a", b"abracadabra abracadabra", bytes(range(256)) * 3, b"aaaaaaaaaaaaaaaa"):
        assert sh.unlz77(sh.lz77(data)) == data
    codes = sh.huffman("abracadabra")
    assert len("".join(codes[c] for c in "abracadabra")) == 23 and not any(a != b and b.startswith(a) for a in codes.values() for b in codes.values())


def test_clusters():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(scale=0.3, size=(15, 2)) + c for c in ((0, 0), (6, 0), (0, 6))])
    truth = np.repeat([0, 1, 2], 15)
    same = truth[:, None] == truth[None]
    for label in (lk.k_medoids(x, 3)[1], lk.affinity_propagation(x, preference=-20), lk.mean_shift(x, 2.0), lk.spectral_clustering(x, 3)):
        assert ((label[:, None] == label[None]) == same).all()
    order, reach = lk.optics(x, 10.0, 3)
    assert (np.diff(truth[order]) != 0).sum() == 2 and np.isfinite(reach[order[1:]]).all()
    y = lk.t_sne(x)
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(axis=2), axis=1)[:, 1]
    assert (truth[near] == truth).mean() > 0.9
    w = lk.self_organising_map(x, 3, 3).reshape(9, 2)
    assert np.sqrt(((x[:, None] - w[None]) ** 2).sum(axis=2).min(axis=1)).mean() < 1.5


def test_regressors():
    x = np.linspace(0, 6, 40)[:, None]
    y = np.sin(x[:, 0])
    mean, variance = lk.gaussian_process(x, y, x[5:8] + 0.01)
    assert np.allclose(mean, np.sin(x[5:8, 0] + 0.01), atol=1e-2) and (variance < 1e-2).all()
    assert np.abs(lk.rbf_network(x, y, x[::4], 1.0)(x) - y).max() < 0.05
    assert np.abs(lk.support_vector_regression(x, y, eps=0.05)(x) - y).max() < 0.2
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 3))
    assert np.allclose(lk.bayesian_ridge(a, a @ [1.0, -2.0, 0.5] + 0.01 * rng.normal(size=200))[0], [1, -2, 0.5], atol=0.02)
    label = np.where((a[:, 0] ** 2 + a[:, 1] ** 2) < 1, 1.0, -1.0)
    assert (np.sign(lk.kernel_svm(a[:, :2], label, c=10.0)(a[:, :2])) == label).mean() > 0.93
    assert lk.forward_probability(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.5, 0.5], [0.1, 0.9]]), [0]) == pytest.approx(0.34)


def test_optimisers():
    value, x = lk.simplex([-3.0, -5.0], [[1, 0], [0, 2], [3, 2]], [4, 12, 18])
    assert value == pytest.approx(-36) and np.allclose(x, [2, 6])
    x = lk.penalty_method(lambda v: (v[0] - 2) ** 2 + (v[1] - 2) ** 2, lambda v: [2 * (v[0] - 2), 2 * (v[1] - 2)], [(lambda v: v[0] + v[1] - 2, lambda v: [1.0, 1.0])], [0.0, 0.0])
    assert np.allclose(x, [1, 1], atol=1e-3)
    t = np.linspace(0, 1, 20)
    got = lk.levenberg_marquardt(lambda p: p[0] * np.exp(p[1] * t) - 2 * np.exp(-1.5 * t), lambda p: np.stack([np.exp(p[1] * t), p[0] * t * np.exp(p[1] * t)], axis=1), [1.0, 0.0])
    assert np.allclose(got, [2, -1.5], atol=1e-6)
    assert lk.gradient_of(lambda v: v[0] * v[1] + v[0] ** 3 / v[1], [2.0, 4.0]) == pytest.approx([4 + 3 * 4 / 4, 2 - 8 / 16])
    assert lk.gradient_of(lambda v: v[0].through(math.sin, math.cos) * 2, [0.0]) == [2.0]


def test_policies():
    for how in ("episode", "step", "clipped"):
        p = lk.Policy(1, 3, rate=0.2, seed=1)
        for _ in range(400):
            a = p.act(0)
            reward = (0.0, 0.2, 1.0)[a]
            if how == "episode":
                p.learn_episode([(0, a, reward)])
            elif how == "step":
                p.learn_step(0, a, reward, None)
            else:
                p.learn_clipped([(0, a, reward)], [reward - 0.4])
        assert p.act(0, greedy=True) == 2


def test_transforms_and_interpolation():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 8))
    assert np.allclose(lk.fft2(x), np.fft.fft2(x))
    at = np.linspace(0, 3, 7)
    assert np.allclose(lk.lagrange([0, 1, 2, 3], [0, 1, 8, 27], at), at**3)
    y = lk.monotone_cubic([0, 1, 2, 3], [0, 0, 1, 1], np.linspace(0, 3, 50))
    assert (np.diff(y) >= -1e-12).all() and y.min() >= 0 and y.max() <= 1
    a, b = [3, 1, 4, 1, 5], [9, 2, 6]
    assert lk.multiply_polynomials(a, b) == np.convolve(a, b).tolist()


def test_ensembles(spark):
    from millrace.operators import learning as ml

    rows = [(i, float(i % 17), float(i % 5), int(i % 17 > 8)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    voted, names = ml.predict_all(ml.bagging(df, "tree", ["a", "b"], "label", 3), df, ["a", "b"])
    assert ml.accuracy(ml.vote(voted, names), "label", "vote") > 0.95
    stacked = ml.stacking(df, ["tree", "logistic"], ["a", "b"], "label", "id", 2)
    assert ml.accuracy(ml.predict_stacked(stacked, df, ["a", "b"]), "label") > 0.95
