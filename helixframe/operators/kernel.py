"""Gapped k-mer kernels as relations (a_id, b_id, k).

The sum over pairs of l-mers within a number of mismatches is rewritten as a signed sum of
equi-joins: pairs that agree on a subset of positions, over the subsets the kernel needs.
Rows are summed per sequence, subset and key before they are joined. Two other plans give
the same values: a neighbour join, which explodes one side to all l-mers within reach, and
the brute-force theta join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import mismatches
from ..functions.tables import Kernel, masks, neighbour_bits
from . import local
from .windows import lmers


def keyed(rows: DataFrame, kernel: Kernel, *group: str) -> DataFrame:
    """rows(group, p, wt) summed by group, subset number t and key."""
    subsets = masks(kernel.h)
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(mask).cast("long").alias("mask")) for t, (mask, _) in enumerate(subsets)])
    out = rows.select(*dict.fromkeys((*group, "p", "wt")), F.inline(table))
    if "p" in group:  # distinct l-mers have one row per subset already
        return out.select(*group, "t", F.col("p").bitwiseAND(F.col("mask")).alias("key"), "wt")
    return out.groupBy(*group, "t", F.col("p").bitwiseAND(F.col("mask")).alias("key")).agg(F.sum("wt").alias("wt"))


def coefficient(kernel: Kernel):
    """The coefficient of subset t."""
    return F.element_at(F.array(*[F.lit(a) for _, a in masks(kernel.h)]), F.col("t") + 1)


def pair_weight(kernel: Kernel, m):
    return F.element_at(F.array(*[F.lit(v) for v in kernel.h]), m + 1)


def choose(kernel: Kernel) -> str:
    """Masked joins unless the ball around an l-mer is smaller than the set of subsets."""
    return "neighbour" if len(masks(kernel.h)) > sum(1 for _ in neighbour_bits(kernel.l, min(kernel.reach, 1))) and kernel.reach <= 1 else "masked"


def raw_of(x: DataFrame, y: DataFrame, kernel: Kernel, strategy: str | None = None, same: bool = False, upper: bool = False) -> DataFrame:
    """k summed over l-mer rows x(id, p, wt) and y(id, p, wt). `same`: only pairs of equal id."""
    strategy = strategy or choose(kernel)
    x = x.select(F.col("id").alias("a_id"), "p", "wt")
    y = y.select(F.col("id").alias("b_id"), "p", F.col("wt").alias("wy"))
    if strategy == "masked":
        left = keyed(x, kernel, "a_id")
        right = keyed(y.withColumnRenamed("wy", "wt"), kernel, "b_id").withColumnRenamed("wt", "wy")
        value, on = coefficient(kernel) * F.col("wt") * F.col("wy"), ["t", "key"]
    elif strategy == "neighbour":
        ball = F.array(*[F.struct(F.lit(b).cast("long").alias("bits"), F.lit(kernel.h[m]).alias("h")) for b, m in neighbour_bits(kernel.l, kernel.reach)])
        left = x.select("a_id", "p", "wt", F.inline(ball)).select("a_id", F.col("p").bitwiseXOR(F.col("bits")).alias("p"), "wt", "h")
        right, value, on = y, F.col("h") * F.col("wt") * F.col("wy"), ["p"]
    elif strategy == "brute":
        right = y.withColumnRenamed("p", "q")
        m = mismatches(F.col("p"), F.col("q"), kernel.l)
        joined = x.join(right, (F.col("a_id") == F.col("b_id")) if same else F.lit(True)).withColumn("m", m).filter(F.col("m") <= kernel.reach)
        if upper:
            joined = joined.filter("a_id <= b_id")
        return joined.groupBy("a_id", "b_id").agg(F.sum(pair_weight(kernel, F.col("m")) * F.col("wt") * F.col("wy")).alias("k"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if same:
        right, on = right.withColumn("a_id", F.col("b_id")), [*on, "a_id"]
    joined = left.join(right.hint("merge"), on)  # Spark takes the size before windows are cut, and would broadcast
    if upper:
        joined = joined.filter("a_id <= b_id")
    return joined.groupBy("a_id", "b_id").agg(F.sum(value).alias("k"))


def against(x: DataFrame, y: DataFrame, kernel: Kernel) -> DataFrame:
    """id, p, v: for the l-mers x(id, p), the weighted sum over those of the same id in
    y(id, p, wt)."""
    left = keyed(x.withColumn("wt", F.lit(1.0)), kernel, "id", "p").drop("wt")
    return left.join(keyed(y, kernel, "id"), ["id", "t", "key"]).groupBy("id", "p").agg(F.sum(coefficient(kernel) * F.col("wt")).alias("v"))


def raw_kernel(x: DataFrame, y: DataFrame, kernel: Kernel, strategy: str | None = None, upper: bool = False, rc_of: str | None = None) -> DataFrame:
    """a_id, b_id, k over sequences x and y (id, seq). Reverse complements are taken of one side
    only, as K(x, rc y) = K(rc x, y): of the smaller one by Spark's estimate, or of `rc_of` ("x"
    or "y"). Pairs whose sequences share nothing have no row: their k is 0."""
    if kernel.include_rc and rc_of is None:
        size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        rc_of = "x" if size(x) < size(y) else "y"
    return raw_of(lmers(x, kernel, kernel.include_rc and rc_of == "x"), lmers(y, kernel, kernel.include_rc and rc_of == "y"), kernel, strategy, upper=upper)


def diagonal(x: DataFrame, kernel: Kernel, strategy: str | None = None) -> DataFrame:
    """id, k: each sequence's kernel with itself, made where the sequence is unless a strategy
    is asked for."""
    if strategy is None:
        return local.diagonal(x, kernel)
    out = raw_of(lmers(x, kernel), lmers(x, kernel, kernel.include_rc), kernel, strategy, same=True)
    return out.select(F.col("a_id").alias("id"), "k")


def normalized(raw: DataFrame, kernel: Kernel, diag_a: DataFrame, diag_b: DataFrame) -> DataFrame:
    """k / sqrt(k_aa k_bb), and the radial function of it for the RBF kernels."""
    out = raw.join(diag_a.select(F.col("id").alias("a_id"), F.col("k").alias("ka")), "a_id").join(diag_b.select(F.col("id").alias("b_id"), F.col("k").alias("kb")), "b_id")
    value = F.col("k") / F.greatest(F.sqrt(F.col("ka") * F.col("kb")), F.lit(1e-10))
    if kernel.rbf:
        value = F.exp((value - 1) * kernel.gamma)
    return out.select("a_id", "b_id", value.alias("k"))


def pairwise(x: DataFrame, y: DataFrame, kernel: Kernel, strategy: str | None = None) -> DataFrame:
    """Kernel values as the model uses them."""
    if strategy is None and all(a > 0 for _, a in masks(kernel.h)) and local.few(y, kernel):
        return local.pairwise(x, y, kernel)
    raw = raw_kernel(x, y, kernel, strategy)
    if not (kernel.normalize or kernel.rbf):
        return raw
    return normalized(raw, kernel, diagonal(x, kernel, strategy), diagonal(y, kernel, strategy))


def gram(x: DataFrame, kernel: Kernel, strategy: str | None = None, mirror: bool = False) -> DataFrame:
    """Upper triangle (a_id <= b_id) of the kernel matrix, or all of it."""
    raw = raw_kernel(x, x, kernel, strategy, upper=True)
    if kernel.normalize or kernel.rbf:
        diag = raw.filter("a_id = b_id").select(F.col("a_id").alias("id"), "k")
        raw = normalized(raw, kernel, diag, diag)
    if mirror:
        raw = raw.unionByName(raw.filter("a_id < b_id").select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "k"))
    return raw


def nearest(x: DataFrame, kernel: Kernel, n: int) -> DataFrame:
    """The n most similar other sequences of each."""
    from pyspark.sql import Window as W

    order = W.partitionBy("a_id").orderBy(F.desc("k"), "b_id")
    pairs = gram(x, kernel, mirror=True).filter("a_id <> b_id").withColumn("k", F.round("k", 9))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
