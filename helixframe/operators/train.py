"""Training: C-SVC and epsilon-SVR on precomputed kernels.

The kernel matrix is a distributed join and aggregate. The dual is solved on the driver, so
the number of training sequences is bounded: `auto` takes the dense matrix while it fits,
and columns fetched from the stored matrix, a bounded number of them held, beyond that.
Nystrom training needs kernel values with `landmarks` sequences only.
"""

from __future__ import annotations

import warnings
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Kernel
from ..plans.shared import materialize, sized
from .evaluate import subsample
from .kernel import diagonal, gram, normalized, raw_kernel
from .model import GkmModel

#: Bytes of kernel values that are fetched at a time.
FETCH_BYTES = 64 << 20
SOLVERS = ("auto", "libsvm", "smo", "nystrom")


class DenseColumns:
    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix

    def __call__(self, i: int) -> np.ndarray:
        return self.matrix[i]


class StoredColumns:
    """Columns of a stored kernel matrix (a, b, k), at most `held` of them in memory; a miss
    fetches `ahead` columns in one job."""

    def __init__(self, table: DataFrame, n: int, rest: float, held: int = 4096, ahead: int = 256):
        self.table, self.n, self.rest, self.held, self.ahead = table, n, rest, held, ahead
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()

    def __call__(self, i: int) -> np.ndarray:
        if i not in self.kept:
            wanted = [j for j in range(i, min(self.n, i + self.ahead)) if j not in self.kept]
            found = {j: np.full(self.n, self.rest) for j in wanted}
            for a, b, k in self.table.filter(F.col("a").isin(wanted)).toPandas().itertuples(index=False):
                found[a][b] = k
            self.kept.update(found)
            while len(self.kept) > max(self.held, self.ahead):
                self.kept.popitem(last=False)
        self.kept.move_to_end(i)
        return self.kept[i]


def solve(column, sign: np.ndarray, linear: np.ndarray, bound: np.ndarray, at: np.ndarray, tolerance: float = 1e-3, most: int = 10_000_000) -> tuple[np.ndarray, float]:
    """Minimises a'Qa / 2 + linear'a with Q_ij = s_i s_j K(at_i, at_j), s'a = 0 and
    0 <= a <= bound, by pairs of variables with the largest second-order decrease. Returns a
    and the offset rho."""
    n = len(sign)
    a, g = np.zeros(n), linear.astype(float).copy()
    columns = lambda i: sign[i] * sign * column(int(at[i]))[at]
    for _ in range(most):
        up = np.where(sign > 0, a < bound, a > 0)
        low = np.where(sign > 0, a > 0, a < bound)
        grade = -sign * g
        if not up.any() or not low.any():
            break
        i = int(np.argmax(np.where(up, grade, -np.inf)))
        worst = np.where(low, grade, np.inf)
        if grade[i] - worst.min() < tolerance:
            break
        qi = columns(i)
        gap = grade[i] - worst
        curve = np.maximum(2.0 - 2.0 * sign[i] * sign * qi, 1e-12)  # K(x, x) = 1
        j = int(np.argmax(np.where(gap > 0, gap * gap / curve, -np.inf)))
        qj = columns(j)
        step = gap[j] / curve[j]
        step = min(step, bound[i] - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else bound[j] - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        for t in (i, j):
            if a[t] < 1e-14 * bound[t]:
                a[t] = 0.0
            elif a[t] > bound[t] * (1 - 1e-14):
                a[t] = bound[t]
        g += step * (sign[i] * qi - sign[j] * qj)
    else:
        warnings.warn("the solver stopped before it converged", stacklevel=2)
    value = sign * g
    free = (a > 0) & (a < bound)
    if free.any():
        return a, float(value[free].mean())
    upper = np.where((sign > 0) & (a == 0) | (sign < 0) & (a == bound), value, np.inf).min()
    lower = np.where((sign > 0) & (a == bound) | (sign < 0) & (a == 0), value, -np.inf).max()
    return a, float((upper + lower) / 2)


def _indexed(seqs: DataFrame, kernel: Kernel) -> DataFrame:
    """id from 0 upwards, seq, y."""
    short = seqs.filter(F.length("seq") < kernel.l).count()
    if short:
        raise ValueError(f"{short} training sequences are shorter than l={kernel.l}")
    from ..plans.prefix import numbered

    rows = seqs.withColumn("_slot", F.pmod(F.xxhash64("id"), F.lit(64)))
    return materialize(numbered(rows, ["_slot"], ["id"], "row").select(F.col("row").alias("id"), "seq", "y"), "train")


def _matrix(rows: DataFrame, kernel: Kernel, n: int, rest: float) -> np.ndarray:
    """The dense kernel matrix. It is stored first and fetched some rows at a time, so the
    driver holds little besides the matrix itself."""
    out = np.full((n, n), rest)
    table = materialize(gram(rows, kernel).repartitionByRange("a_id"), "gram")
    step = max(1, FETCH_BYTES // (24 * n))
    for lo in range(0, n, step):
        part = table.filter(F.col("a_id").between(lo, lo + step - 1)).toArrow()
        a, b, k = (part.column(c).to_numpy() for c in ("a_id", "b_id", "k"))
        out[a, b] = k
        out[b, a] = k
    return out


def nystrom_features(rows: DataFrame, kernel: Kernel, n: int, landmarks: int, seed: int, rest: float) -> np.ndarray:
    """Rows whose inner products approximate the kernel."""
    chosen = subsample(rows, landmarks, seed=seed)
    raw = raw_kernel(rows, chosen, kernel)
    pairs = normalized(raw, kernel, diagonal(rows, kernel), diagonal(chosen, kernel)).toPandas()
    ids = np.sort(np.array([r["id"] for r in chosen.select("id").collect()]))
    block = np.full((n, len(ids)), rest)
    block[pairs["a_id"].to_numpy(), np.searchsorted(ids, pairs["b_id"].to_numpy())] = pairs["k"].to_numpy()
    value, vector = np.linalg.eigh(block[ids])
    keep = value > max(1e-10, 1e-8 * value.max())
    return block @ (vector[:, keep] / np.sqrt(value[keep]))


def _columns(rows: DataFrame, kernel: Kernel, n: int, solver: str, landmarks: int, seed: int, max_gram_gb: float):
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; known: {', '.join(SOLVERS)}")
    rest = float(np.exp(-kernel.gamma)) if kernel.rbf else 0.0
    if solver == "auto":
        solver = "libsvm" if n * n * 8 / 2**30 <= max_gram_gb else "smo"
    if solver == "nystrom":
        features = nystrom_features(rows, kernel, n, min(landmarks, n), seed, rest)
        return lambda i: features @ features[i]
    if solver == "smo":
        pairs = gram(rows, kernel, mirror=True).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "k")
        return StoredColumns(materialize(pairs.repartitionByRange("a"), "gram"), n, rest)
    return DenseColumns(_matrix(rows, kernel, n, rest))


def _model(rows: DataFrame, coef: np.ndarray, rho: float, kernel: Kernel) -> GkmModel:
    used = np.flatnonzero(np.abs(coef) > 1e-10)
    spark = rows.sparkSession
    table = spark.createDataFrame([(int(i), float(coef[i])) for i in used], "id long, coef double")
    return GkmModel(materialize(rows.join(sized(table), "id").select("id", "seq", "coef"), "sv"), kernel, -rho)


def train_svc(positive: DataFrame, negative: DataFrame, kernel: Kernel | None = None, C: float = 1.0, pos_weight: float = 1.0, solver: str = "auto", landmarks: int = 1000, seed: int = 42, tolerance: float = 1e-3, max_gram_gb: float = 4.0) -> GkmModel:
    """positive and negative: id, seq. C is multiplied by pos_weight for positives."""
    kernel = kernel or Kernel()
    one = positive.select(F.struct(F.lit(0).alias("c"), F.col("id").alias("i")).alias("id"), "seq", F.lit(1.0).alias("y"))
    two = negative.select(F.struct(F.lit(1).alias("c"), F.col("id").alias("i")).alias("id"), "seq", F.lit(-1.0).alias("y"))
    rows = _indexed(one.unionByName(two), kernel)
    y = np.array([r["y"] for r in rows.orderBy("id").select("y").collect()])
    if not (y > 0).any() or not (y < 0).any():
        raise ValueError("training needs sequences of both classes")
    column = _columns(rows, kernel, len(y), solver, landmarks, seed, max_gram_gb)
    a, rho = solve(column, y, -np.ones(len(y)), np.where(y > 0, C * pos_weight, C), np.arange(len(y)), tolerance)
    return _model(rows, a * y, rho, kernel)


def train_svr(seqs: DataFrame, kernel: Kernel | None = None, C: float = 1.0, epsilon: float = 0.1, solver: str = "auto", landmarks: int = 1000, seed: int = 42, tolerance: float = 1e-3, max_gram_gb: float = 4.0) -> GkmModel:
    """seqs: id, seq, y. The dual has two variables for each sequence."""
    kernel = kernel or Kernel()
    rows = _indexed(seqs.select("id", "seq", F.col("y").cast("double")), kernel)
    z = np.array([r["y"] for r in rows.orderBy("id").select("y").collect()])
    n = len(z)
    column = _columns(rows, kernel, n, solver, landmarks, seed, max_gram_gb)
    sign = np.concatenate([np.ones(n), -np.ones(n)])
    a, rho = solve(column, sign, np.concatenate([epsilon - z, epsilon + z]), np.full(2 * n, C), np.concatenate([np.arange(n)] * 2), tolerance)
    return _model(rows, a[:n] - a[n:], rho, kernel)
