"""Learners for samples that fit one machine, in numpy: the sample's size is the caller's bound. Apply them to groups with applyInPandas."""

from __future__ import annotations

import numpy as np


def gaussian_process(x, y, at, length: float = 1.0, noise: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at new points, with a squared-exponential kernel."""
    k = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(axis=2) / length**2)
    factor = np.linalg.cholesky(k(x, x) + noise * np.eye(len(x)))
    alpha = np.linalg.solve(factor.T, np.linalg.solve(factor, y))
    cross = k(at, x)
    v = np.linalg.solve(factor, cross.T)
    return cross @ alpha, np.maximum(1 - (v * v).sum(axis=0), 0)


def bayesian_ridge(x, y, rounds: int = 100) -> tuple[np.ndarray, float, float]:
    """Weights, noise precision and weight precision that make the evidence greatest."""
    n, d = x.shape
    values, vectors = np.linalg.eigh(x.T @ x)
    target, alpha, beta = vectors.T @ (x.T @ y), 1.0, 1.0 / max(y.var(), 1e-9)
    for _ in range(rounds):
        w = vectors @ (beta * target / (alpha + beta * values))
        gamma = (beta * values / (alpha + beta * values)).sum()
        alpha, beta = gamma / max(w @ w, 1e-12), max(n - gamma, 1e-9) / max(((y - x @ w) ** 2).sum(), 1e-12)
    return w, beta, alpha


def k_medoids(x, k: int, rounds: int = 100) -> tuple[list[int], np.ndarray]:
    """Medoids (greedy start, then swaps by cluster) and labels."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    medoids = [int(d.sum(axis=1).argmin())]
    while len(medoids) < k:
        medoids.append(int(np.maximum(d[:, medoids].min(axis=1)[:, None] - d, 0).sum(axis=0).argmax()))
    for _ in range(rounds):
        label = d[:, medoids].argmin(axis=1)
        new = [int(m[d[np.ix_(m, m)].sum(axis=1).argmin()]) if len(m := np.flatnonzero(label == c)) else medoids[c] for c in range(k)]
        if new == medoids:
            break
        medoids = new
    return medoids, d[:, medoids].argmin(axis=1)


def affinity_propagation(x, damping: float = 0.7, rounds: int = 300, preference: float | None = None) -> np.ndarray:
    """Label per row: the place of its exemplar."""
    s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    n = len(x)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if preference is None else preference)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        t = a + s
        best = t.argmax(axis=1)
        first = t[np.arange(n), best]
        t[np.arange(n), best] = -np.inf
        new = s - first[:, None]
        new[np.arange(n), best] = s[np.arange(n), best] - t.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(axis=0)[None] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    return (a + r).argmax(axis=1)


def mean_shift(x, bandwidth: float, rounds: int = 200) -> np.ndarray:
    """Labels of the modes that points climb to with a flat kernel."""
    at = x.astype(float).copy()
    for _ in range(rounds):
        near = (((at[:, None] - x[None]) ** 2).sum(axis=2) <= bandwidth**2).astype(float)
        new = near @ x / near.sum(axis=1)[:, None]
        if np.abs(new - at).max() < 1e-6:
            break
        at = new
    label, modes = np.empty(len(x), int), []
    for i, p in enumerate(at):
        k = next((k for k, m in enumerate(modes) if ((m - p) ** 2).sum() <= bandwidth**2), len(modes))
        if k == len(modes):
            modes.append(p)
        label[i] = k
    return label


def optics(x, eps: float, min_points: int) -> tuple[list[int], np.ndarray]:
    """Order of the points and their reachability."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(min_points, len(x) - 1)]
    core = np.where(core <= eps, core, np.inf)
    reach, order, left = np.full(len(x), np.inf), [], set(range(len(x)))
    while left:
        i = min(left, key=lambda k: (reach[k], k))
        left.discard(i)
        order.append(i)
        if core[i] < np.inf:
            for j in left:
                if d[i, j] <= eps:
                    reach[j] = min(reach[j], max(core[i], d[i, j]))
    return order, reach


def spectral_clustering(x, k: int, gamma: float = 1.0, seed: int = 0) -> np.ndarray:
    """k-means over the first eigenvectors of the normalised Laplacian."""
    w = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    root = 1 / np.sqrt(w.sum(axis=1))
    _, v = np.linalg.eigh(np.eye(len(x)) - root[:, None] * w * root[None])
    v = v[:, :k] / np.linalg.norm(v[:, :k], axis=1, keepdims=True)
    return k_medoids(v, k)[1]


def t_sne(x, perplexity: float = 10.0, rounds: int = 400, rate: float = 50.0, seed: int = 0) -> np.ndarray:
    """Two coordinates per row (exact gradients, early exaggeration)."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi = 1e-10, 1e10
        for _ in range(60):
            b = np.sqrt(lo * hi)
            away = d[i] - d[i][np.arange(n) != i].min()
            away[i] = np.inf
            q = np.exp(-away * b)
            q /= q.sum()
            entropy = -(q[q > 0] * np.log(q[q > 0])).sum()
            lo, hi = (b, hi) if entropy > np.log(perplexity) else (lo, b)
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, v = np.random.default_rng(seed).normal(scale=1e-2, size=(n, 2)), np.zeros((n, 2))
    for t in range(rounds):
        w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(w, 0)
        g = ((4 if t < 100 else 1) * p - np.maximum(w / w.sum(), 1e-12)) * w
        v = (0.5 if t < 100 else 0.8) * v - rate * 4 * (np.diag(g.sum(axis=1)) - g) @ y
        y = y + v
        y -= y.mean(axis=0)
    return y


def self_organising_map(x, rows: int, columns: int, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Weights (rows, columns, features) of a map trained in batches."""
    rng = np.random.default_rng(seed)
    w = x[rng.choice(len(x), rows * columns)].astype(float)
    place = np.array([(r, c) for r in range(rows) for c in range(columns)], float)
    for t in range(rounds):
        width = max(rows, columns) / 2 * (0.5 / max(rows, columns)) ** (t / max(rounds - 1, 1)) + 0.3
        best = ((x[:, None] - w[None]) ** 2).sum(axis=2).argmin(axis=1)
        h = np.exp(-((place[best][:, None] - place[None]) ** 2).sum(axis=2) / (2 * width**2))
        w = (h.T @ x) / h.sum(axis=0)[:, None]
    return w.reshape(rows, columns, -1)


def rbf_network(x, y, centres, width: float, ridge: float = 1e-8):
    """A predictor: Gaussian features around centres and a linear layer."""
    f = lambda v: np.c_[np.ones(len(v)), np.exp(-((v[:, None] - centres[None]) ** 2).sum(axis=2) / (2 * width**2))]
    a = f(x)
    w = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y)
    return lambda v: f(v) @ w


def kernel_svm(x, y, c: float = 1.0, gamma: float = 1.0, rounds: int = 2000, rate: float = 0.01):
    """A decision function for labels -1 and 1, by projected ascent on the dual with a Gaussian kernel (offset in the kernel)."""
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2)) + 1
    q = y[:, None] * y[None] * k(x, x)
    alpha, step = np.zeros(len(x)), min(rate, 1 / max(np.linalg.norm(q, 2), 1e-9))
    for _ in range(rounds):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, c)
    return lambda v: k(v, x) @ (alpha * y)


def support_vector_regression(x, y, c: float = 10.0, eps: float = 0.1, gamma: float = 1.0, rounds: int = 4000):
    """A predictor with an insensitive margin, by proximal steps on the dual."""
    k = lambda a, b: np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2)) + 1
    m = k(x, x)
    step, beta = 1 / np.linalg.norm(m, 2), np.zeros(len(x))
    for _ in range(rounds):
        b = beta + step * (y - m @ beta)
        beta = np.clip(np.sign(b) * np.maximum(np.abs(b) - step * eps, 0), -c, c)
    return lambda v: k(v, x) @ beta


def forward_probability(start, moves, emits, seen) -> float:
    """Probability of what a hidden Markov model emits."""
    a = start * emits[:, seen[0]]
    for o in seen[1:]:
        a = (a @ moves) * emits[:, o]
    return float(a.sum())


def simplex(cost, a, b) -> tuple[float, np.ndarray]:
    """Least cost'x with a x <= b, x >= 0 and b >= 0, by Bland's rule."""
    a, b, cost = (np.asarray(v, float) for v in (a, b, cost))
    m, n = a.shape
    table = np.block([[a, np.eye(m), b[:, None]], [cost[None], np.zeros((1, m + 1))]])
    basis = list(range(n, n + m))
    while (enter := next((j for j in range(n + m) if table[-1, j] < -1e-12), None)) is not None:
        ratios = [(table[i, -1] / table[i, enter], basis[i], i) for i in range(m) if table[i, enter] > 1e-12]
        if not ratios:
            raise ValueError("unbounded")
        *_, leave = min(ratios)
        table[leave] /= table[leave, enter]
        for i in range(m + 1):
            if i != leave:
                table[i] -= table[i, enter] * table[leave]
        basis[leave] = enter
    x = np.zeros(n + m)
    x[basis] = table[:-1, -1]
    return float(cost @ x[:n]), x[:n]


def penalty_method(f, grad, constraints, x0, weight: float = 10.0, rounds: int = 8) -> np.ndarray:
    """Least f with every constraint (value, gradient) at most 0, by growing quadratic penalties."""
    from millrace.operators.signal import minimise

    x = np.asarray(x0, float)
    for _ in range(rounds):
        total = lambda v, w=weight: f(v) + w * sum(max(c(v), 0.0) ** 2 for c, _ in constraints)
        slope = lambda v, w=weight: np.asarray(grad(v)) + 2 * w * sum((max(c(v), 0.0) * np.asarray(d(v)) for c, d in constraints), np.zeros(len(x)))
        x = minimise(total, slope, x)
        weight *= 5
    return x


def levenberg_marquardt(residual, jacobian, x0, rounds: int = 200, tol: float = 1e-12) -> np.ndarray:
    x, damp = np.asarray(x0, float), 1e-3
    r = residual(x)
    for _ in range(rounds):
        j = jacobian(x)
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.maximum(h.diagonal(), 1e-12)), -j.T @ r)
        new = residual(x + step)
        if new @ new < r @ r:
            x, r, damp = x + step, new, damp / 3
            if np.abs(step).max() < tol:
                break
        else:
            damp *= 4
    return x


class Dual:
    """A number with its derivative: functions of plain arithmetic give both."""

    def __init__(self, value, slope=0.0):
        self.value, self.slope = value, slope

    @staticmethod
    def of(x):
        return x if isinstance(x, Dual) else Dual(x)

    def __add__(self, o):
        o = Dual.of(o)
        return Dual(self.value + o.value, self.slope + o.slope)

    def __neg__(self):
        return Dual(-self.value, -self.slope)

    def __sub__(self, o):
        return self + -Dual.of(o)

    def __rsub__(self, o):
        return Dual.of(o) - self

    def __mul__(self, o):
        o = Dual.of(o)
        return Dual(self.value * o.value, self.slope * o.value + self.value * o.slope)

    def __truediv__(self, o):
        o = Dual.of(o)
        return Dual(self.value / o.value, (self.slope * o.value - self.value * o.slope) / o.value**2)

    def __rtruediv__(self, o):
        return Dual.of(o) / self

    def __pow__(self, n: float):
        return Dual(self.value**n, n * self.value ** (n - 1) * self.slope)

    def through(self, f, df):
        """f of this number, given f's derivative."""
        return Dual(f(self.value), df(self.value) * self.slope)

    __radd__, __rmul__ = __add__, __mul__


def gradient_of(f, x) -> list[float]:
    """Partial derivatives of a function of a list, one forward pass each."""
    return [f([Dual(v, float(i == k)) for i, v in enumerate(x)]).slope for k in range(len(x))]


class Policy:
    """A softmax policy over a table of preferences, with a table of state values; rewards are discounted."""

    def __init__(self, states: int, actions: int, rate: float = 0.1, value_rate: float = 0.1, discount: float = 0.99, seed: int = 0):
        self.preference, self.value = np.zeros((states, actions)), np.zeros(states)
        self.rate, self.value_rate, self.discount, self.random = rate, value_rate, discount, np.random.default_rng(seed)

    def probabilities(self, state: int) -> np.ndarray:
        e = np.exp(self.preference[state] - self.preference[state].max())
        return e / e.sum()

    def act(self, state: int, greedy: bool = False) -> int:
        p = self.probabilities(state)
        return int(p.argmax()) if greedy else int(self.random.choice(len(p), p=p))

    def _push(self, state: int, action: int, strength: float) -> None:
        slope = -self.probabilities(state)
        slope[action] += 1
        self.preference[state] += self.rate * strength * slope

    def learn_episode(self, steps: list[tuple[int, int, float]]) -> None:
        """Policy gradient over (state, action, reward), with the state's value as the baseline."""
        back = 0.0
        for state, action, reward in reversed(steps):
            back = reward + self.discount * back
            surprise = back - self.value[state]
            self.value[state] += self.value_rate * surprise
            self._push(state, action, surprise)

    def learn_step(self, state: int, action: int, reward: float, after: int | None) -> float:
        """Actor and critic move by one step's surprise, which is returned."""
        surprise = reward + (0.0 if after is None else self.discount * self.value[after]) - self.value[state]
        self.value[state] += self.value_rate * surprise
        self._push(state, action, surprise)
        return float(surprise)

    def learn_clipped(self, steps: list[tuple[int, int, float]], advantages: list[float], clip: float = 0.2, rounds: int = 4) -> None:
        """Proximal updates: no push once the action's probability has left the clip range on the side of its advantage."""
        old = [self.probabilities(s)[a] for s, a, _ in steps]
        for _ in range(rounds):
            for (s, a, _), p, gain in zip(steps, old, advantages):
                ratio = self.probabilities(s)[a] / p
                if (gain > 0 and ratio < 1 + clip) or (gain < 0 and ratio > 1 - clip):
                    self._push(s, a, gain * ratio)


def fft2(x: np.ndarray) -> np.ndarray:
    """Two-dimensional transform, rows then columns; sides are powers of two."""
    if any(n & (n - 1) for n in x.shape):
        raise ValueError("sides must be powers of two")
    return np.fft.fft(np.fft.fft(x, axis=1), axis=0)


def lagrange(x, y, at) -> np.ndarray:
    """The polynomial through all points, at new places."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    out = np.zeros(at.shape)
    for i in range(len(x)):
        out += y[i] * np.prod([(at - x[j]) / (x[i] - x[j]) for j in range(len(x)) if j != i], axis=0)
    return out


def monotone_cubic(x, y, at) -> np.ndarray:
    """Cubic pieces that never overshoot: slopes are harmonic means, zero where the data turn."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    m[0], m[-1] = d[0], d[-1]
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + m[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + m[k + 1] * h[k] * t * t * (t - 1)


def number_transform(a: list[int], root: int = 3, modulus: int = 998244353) -> list[int]:
    """Transform of a power-of-two list modulo a prime, used to multiply polynomials without rounding."""
    n = len(a)
    if n == 1:
        return a
    even, odd = number_transform(a[0::2], root, modulus), number_transform(a[1::2], root, modulus)
    w, step, out = 1, pow(root, (modulus - 1) // n, modulus), [0] * n
    for k in range(n // 2):
        t = w * odd[k] % modulus
        out[k], out[k + n // 2] = (even[k] + t) % modulus, (even[k] - t) % modulus
        w = w * step % modulus
    return out


def multiply_polynomials(a: list[int], b: list[int], modulus: int = 998244353) -> list[int]:
    n = 1 << (len(a) + len(b) - 2).bit_length()
    x, y = (number_transform(v + [0] * (n - len(v)), 3, modulus) for v in (a, b))
    z = number_transform([p * q % modulus for p, q in zip(x, y)], pow(3, -1, modulus), modulus)
    return [v * pow(n, -1, modulus) % modulus for v in z[: len(a) + len(b) - 1]]
