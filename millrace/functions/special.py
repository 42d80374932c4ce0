"""Special functions in numpy: error function, incomplete gamma and beta, Bessel functions. No SciPy is needed.

The incomplete functions are worked out for all values at once, by series or continued fractions (published forms).
"""

from __future__ import annotations

import math

import numpy as np


def lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(np.asarray(x, float))


def erf(x):
    return np.vectorize(math.erf, otypes=[float])(np.asarray(x, float))


def beta(a, b):
    return np.exp(lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + b))


def gammainc(a, x):
    """Regularised lower incomplete gamma P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    pos = x > 0
    front = np.zeros(a.shape)
    front[pos] = np.exp(-x[pos] + a[pos] * np.log(x[pos]) - lgamma(a[pos]))
    small = pos & (x < a + 1)
    if small.any():
        s, n = a[small], x[small]
        term = 1 / s
        total, k = term.copy(), s.copy()
        for _ in range(1000):
            k += 1
            term = term * n / k
            total += term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        out[small] = total * front[small]
    large = pos & ~small
    if large.any():
        s, n = a[large], x[large]
        b = n + 1 - s
        c = np.full(s.shape, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[large] = 1 - front[large] * h
    return out


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float)))
    x = np.clip(x, 0, 1)
    inner = (x > 0) & (x < 1)
    front = np.zeros(x.shape)
    front[inner] = np.exp(lgamma(a[inner] + b[inner]) - lgamma(a[inner]) - lgamma(b[inner]) + a[inner] * np.log(x[inner]) + b[inner] * np.log1p(-x[inner]))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones(x.shape)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    half = front * h / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - half, half)))


def bessel_j(n: int, x):
    """J_n by its integral, which the trapezoid rule gives to machine precision for whole n."""
    t = np.linspace(0, math.pi, 2001)[:, None]
    return np.trapezoid(np.cos(n * t - np.atleast_1d(x) * np.sin(t)), t[:, 0], axis=0) / math.pi


def bessel_y(n: int, x):
    """Y_n for x > 0 by its integrals."""
    x = np.atleast_1d(np.asarray(x, float))
    t = np.linspace(0, math.pi, 4001)[:, None]
    first = np.trapezoid(np.sin(x * np.sin(t) - n * t), t[:, 0], axis=0)
    u = np.linspace(0, 12, 24001)[:, None]
    second = np.trapezoid((np.exp(n * u) + (-1) ** n * np.exp(-n * u)) * np.exp(-x * np.sinh(u)), u[:, 0], axis=0)
    return (first - second) / math.pi
