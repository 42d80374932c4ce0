"""Linear algebra: sparse matrices as coordinate tables (i, j, v), and small dense systems solved on the driver.

Coordinates are unique per (i, j) unless said otherwise; ``tidy`` sums repeated ones. Zeros that arise are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import stored

#: Columns of a dense system that the driver solves.
MOST_COLUMNS = 2000


def tidy(m: DataFrame) -> DataFrame:
    return m.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * by)


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    return tidy(scale(a, alpha).unionByName(scale(b, beta)))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "_v"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("_v")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the inner index, sum products: one shuffle for the join, one for the sums, partial sums before it."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(right, F.col("j") == F.col("_k")).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def matvec(m: DataFrame, x: DataFrame) -> DataFrame:
    """x as (pos, v); the result has the rows that m has."""
    return m.join(x.select(F.col("pos").alias("j"), F.col("v").alias("_x")), "j").groupBy(F.col("i").alias("pos")).agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def trace(m: DataFrame) -> DataFrame:
    return m.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select(F.col("i").alias("pos"), "v")


def norms(m: DataFrame) -> DataFrame:
    """Frobenius, largest absolute, largest column sum (one) and largest row sum (inf)."""
    rows = m.groupBy("i").agg(F.sum(F.abs("v")).alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max(F.abs("v")).alias("m"))
    columns = m.groupBy("j").agg(F.sum(F.abs("v")).alias("c")).agg(F.max("c").alias("one"))
    return rows.agg(F.sqrt(F.sum("q")).alias("frobenius"), F.max("m").alias("most"), F.max("s").alias("inf")).crossJoin(columns)


def kronecker(a: DataFrame, b: DataFrame, b_rows: int, b_columns: int) -> DataFrame:
    """a (x) b; b must fit a broadcast, which is checked (a million entries)."""
    if b.limit(1_000_001).count() > 1_000_000:
        raise ValueError("the right factor has over a million entries")
    small = F.broadcast(b.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v")))
    return a.crossJoin(small).select((F.col("i") * b_rows + F.col("_i")).alias("i"), (F.col("j") * b_columns + F.col("_j")).alias("j"), (F.col("v") * F.col("_v")).alias("v"))


def dot(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.sum(F.col(x) * F.col(y)).alias("dot"))


def axpy(df: DataFrame, a: float, x: str, y: str) -> DataFrame:
    return df.withColumn(y, a * F.col(x) + F.col(y))


def vector_norms(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias("nrm2"), F.sum(F.abs(x)).alias("asum"), F.max(F.abs(x)).alias("amax"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X of data columns, from one aggregate."""
    if len(columns) > MOST_COLUMNS:
        raise ValueError("too many columns")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])) for i, j in pairs)).first()
    out = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v
    return out


def least_squares(df: DataFrame, columns: list[str], y: str, ridge: float = 0.0) -> list[float]:
    """Coefficients (intercept first) of y on the columns by normal equations; the intercept is not penalised."""
    full = df.withColumn("_one", F.lit(1.0))
    g = gram(full, ["_one", *columns, y])
    a, b = g[:-1, :-1], g[:-1, -1]
    penalty = ridge * np.eye(len(a))
    penalty[0, 0] = 0
    return np.linalg.solve(a + penalty, b).tolist() if np.linalg.matrix_rank(a + penalty) == len(a) else np.linalg.lstsq(a + penalty, b, rcond=None)[0].tolist()


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positive definite by Cholesky, square by LU, tall by QR; wide raises."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    m, n = a.shape
    if n > m:
        raise ValueError("more unknowns than equations")
    if m > n:
        q, r = np.linalg.qr(a)
        return np.linalg.solve(r, q.T @ b)
    if np.allclose(a, a.T):
        try:
            factor = np.linalg.cholesky(a)
            return np.linalg.solve(factor.T, np.linalg.solve(factor, b))
        except np.linalg.LinAlgError:
            pass
    return np.linalg.solve(a, b)


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, L with ones on its diagonal, and U, by partial pivoting."""
    u = np.array(a, float)
    n = len(u)
    order, low = np.arange(n), np.eye(n)
    for k in range(n - 1):
        p = k + int(np.abs(u[k:, k]).argmax())
        if p != k:
            u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
            low[[k, p], :k] = low[[p, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return order, low, np.triu(u)


#: Entries of a vector that the driver holds while a system is solved or an eigenvalue found.
MOST_ENTRIES = 1_000_000


def _product(m: DataFrame, n: int):
    """x -> m x for a coordinate table that is written once; the vectors are on the driver, their length is checked."""
    if n > MOST_ENTRIES:
        raise ValueError(f"the vector has over {MOST_ENTRIES} entries")
    spark, table = m.sparkSession, stored(m)

    def times(x: np.ndarray) -> np.ndarray:
        frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "pos long, v double")
        out = np.zeros(n)
        for r in matvec(table, F.broadcast(frame)).collect():
            out[r[0]] = r[1]
        return out

    return times


def inverse_diagonal(m: DataFrame, n: int) -> np.ndarray:
    """One over each entry of the diagonal, as a preconditioner; one where that is 0 or missing."""
    out = np.ones(n)
    for r in m.where("i = j and v != 0").groupBy("i").agg(F.sum("v")).collect():
        out[r[0]] = 1 / r[1]
    return out


def conjugate_gradient(m: DataFrame, b: np.ndarray, tol: float = 1e-8, rounds: int = 500, preconditioner: np.ndarray | None = None) -> np.ndarray:
    """Solution of a positive definite system whose matrix is a coordinate table."""
    times, scale_by = _product(m, len(b)), 1.0 if preconditioner is None else preconditioner
    x, r = np.zeros(len(b)), np.asarray(b, float)
    z = scale_by * r
    p, rz = z.copy(), float(r @ z)
    for _ in range(rounds):
        if np.linalg.norm(r) <= tol:
            break
        ap = times(p)
        alpha = rz / float(p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        z = scale_by * r
        new = float(r @ z)
        p, rz = z + new / rz * p, new
    return x


def stabilised_gradients(m: DataFrame, b: np.ndarray, tol: float = 1e-8, rounds: int = 500, preconditioner: np.ndarray | None = None) -> np.ndarray:
    """Solution of a general system by two coupled gradients, the second of which smooths the first; raises if it breaks down."""
    times, scale_by = _product(m, len(b)), 1.0 if preconditioner is None else preconditioner
    x, r = np.zeros(len(b)), np.asarray(b, float)
    shadow, p = r.copy(), r.copy()
    rho = float(shadow @ r)
    for _ in range(rounds):
        if np.linalg.norm(r) <= tol:
            return x
        hat = scale_by * p
        v = times(hat)
        if (down := float(shadow @ v)) == 0:
            raise ValueError("the iteration broke down")
        alpha = rho / down
        s = r - alpha * v
        s_hat = scale_by * s
        t = times(s_hat)
        omega = float(t @ s) / (float(t @ t) or 1.0)
        x, r = x + alpha * hat + omega * s_hat, s - omega * t
        if np.linalg.norm(r) <= tol:
            return x
        new = float(shadow @ r)
        if new == 0 or omega == 0:
            raise ValueError("the iteration broke down")
        p, rho = r + new / rho * alpha / omega * (p - omega * v), new
    return x


def minimal_residual(m: DataFrame, b: np.ndarray, tol: float = 1e-8, restart: int = 30, rounds: int = 20, preconditioner: np.ndarray | None = None) -> np.ndarray:
    """Solution of a general system: the least residual over a growing basis of products, begun anew after ``restart`` of them."""
    times, scale_by = _product(m, len(b)), 1.0 if preconditioner is None else preconditioner
    b = np.asarray(b, float)
    x = np.zeros(len(b))
    for _ in range(rounds):
        r = b - times(x)
        if (size := np.linalg.norm(r)) <= tol:
            break
        basis, h = [r / size], np.zeros((restart + 1, restart))
        for k in range(restart):
            w = times(scale_by * basis[k])
            for i, q in enumerate(basis):
                h[i, k] = q @ w
                w = w - h[i, k] * q
            h[k + 1, k] = np.linalg.norm(w)
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], np.r_[size, np.zeros(k + 1)], rcond=None)
            left = np.linalg.norm(np.r_[size, np.zeros(k + 1)] - h[: k + 2, : k + 1] @ y)
            if left <= tol or h[k + 1, k] < 1e-14:
                break
            basis.append(w / h[k + 1, k])
        x = x + scale_by * (np.array(basis[: len(y)]).T @ y)
    return x


def principal_axes(df: DataFrame, columns: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, the k first axes (rows, the largest entry positive) and their variances, from one aggregate of moments (divisor n - 1)."""
    n, *means = df.agg(F.count("*"), *(F.avg(c) for c in columns)).first()
    centred = df.select(*((F.col(c) - F.lit(m)).alias(c) for c, m in zip(columns, means)))
    values, vectors = np.linalg.eigh(gram(centred, columns) / (n - 1))
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order].T
    return np.array(means), axes * np.sign(axes[np.arange(len(order)), np.abs(axes).argmax(axis=1)])[:, None], values[order]


def power_iteration(m: DataFrame, n: int, rounds: int = 100) -> tuple[float, np.ndarray]:
    """The largest eigenvalue of a symmetric coordinate table and its vector."""
    times, x = _product(m, n), np.ones(n) / n**0.5
    now = value = 0.0
    for _ in range(rounds):
        y = times(x)
        now = float(x @ y)
        x = y / (np.linalg.norm(y) or 1.0)
        if abs(now - value) < 1e-10 * max(1.0, abs(now)):
            break
        value = now
    return now, x
