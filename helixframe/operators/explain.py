"""Attributions: how each letter of a sequence adds to its score.

Pairs of l-mers within reach come from equi-joins on the smallest position subsets the
reach allows; a pair that agrees on several subsets is kept at the first only, so no
distinct is needed. Linear kernels use the support vectors' summed l-mers, so the work does
not grow with the number of support vectors.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, forward, mismatches
from ..functions.tables import importance_weights, perturbation_weights, position_bits
from .kernel import diagonal
from .model import GkmModel
from .windows import lmers, windows


def close_pairs(left: DataFrame, right: DataFrame, l: int, reach: int) -> DataFrame:
    """p, q, m of left(p) and right(q) with at most `reach` mismatches, each pair once."""
    size = max(l - reach, 0)
    ones = sum(4**i for i in range(l))
    subsets = [position_bits(l, c) for c in combinations(range(l), size)]
    table = F.array(*[F.struct(F.lit(x).cast("long").alias("mask")) for x in subsets])
    a = left.select("p", F.inline(table)).withColumn("key", F.col("p").bitwiseAND(F.col("mask")))
    b = right.select("q", F.inline(table)).withColumn("key", F.col("q").bitwiseAND(F.col("mask")))
    x = F.col("p").bitwiseXOR(F.col("q"))
    equal = F.shiftrightunsigned(x, 1).bitwiseOR(x).bitwiseAND(F.lit(ones)).bitwiseXOR(F.lit(ones)) * 3
    # the first subset: its positions are the least significant of those that agree
    low = F.greatest(F.col("mask"), F.lit(0))
    upto = (F.pow(F.lit(2.0), F.length(F.bin(low))).cast("long") - 1) if size else F.lit(0)
    return a.join(b, ["mask", "key"]).filter(equal.bitwiseAND(upto) == F.col("mask")).select("p", "q", mismatches(F.col("p"), F.col("q"), l).alias("m"))


def _base_at(p, at, l: int):
    digit = F.call_function("shiftrightunsigned", p, (F.lit(l - 1) - at) * 2).bitwiseAND(F.lit(3))
    return F.element_at(F.array(*[F.lit(b) for b in BASES]), digit.cast("int") + 1)


def _shares(pairs: DataFrame, l: int, match: list[float], other: list[float], perturb: bool, *keep: str) -> DataFrame:
    """pairs(p, q, m, v, keep) -> keep, p, at, base, value summed per l-mer p."""
    table = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("m") + 1)
    rows = pairs.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(l - 1)))).withColumn("a", _base_at(F.col("p"), F.col("at"), l)).withColumn("b", _base_at(F.col("q"), F.col("at"), l))
    same, change = F.col("a") == F.col("b"), F.col("v") * F.when(F.col("a") == F.col("b"), table(match)).otherwise(table(other))
    rows = rows.withColumn("value", change)
    if perturb:  # a broken match changes the three other letters alike
        three = F.filter(F.array(*[F.lit(b) for b in BASES]), lambda c: c != F.col("a"))
        rows = rows.withColumn("base", F.explode(F.when(same, three).otherwise(F.array("b"))))
    else:
        rows = rows.withColumn("base", F.col("b"))
    return rows.groupBy(*keep, "p", "at", "base").agg(F.sum("value").alias("value"))


def explain(model: GkmModel, seqs: DataFrame, mode: str = "importance") -> DataFrame:
    """id, pos, base, value. "hypothetical": what each letter would add at each position;
    "importance": of the sequence's own letters; "perturbation": first-order change of the
    kernel sum under the sequence's own norm. All positions have rows; NaN if shorter than l."""
    if mode not in ("importance", "hypothetical", "perturbation"):
        raise ValueError(f"unknown mode {mode!r}")
    kernel, perturb = model.kernel, mode == "perturbation"
    l, h = kernel.l, kernel.h
    match, other = perturbation_weights(h) if perturb else importance_weights(h, kernel.d)
    reach = max((m for m in range(l + 1) if match[m] or other[m]), default=0)
    places = windows(seqs, kernel)
    scaled = kernel.normalize or kernel.rbf
    if kernel.rbf:
        found = _by_vector(model, seqs, places, match, other, perturb, reach)
    else:
        sums = model.lmer_sums().filter("v <> 0")
        pairs = close_pairs(places.select("p").distinct(), sums.select(F.col("p").alias("q")), l, reach)
        pairs = pairs.join(sums.select(F.col("p").alias("q"), "v"), "q")
        shares = _shares(pairs, l, match, other, perturb)
        found = places.join(shares, "p").groupBy("id", (F.col("pos") + F.col("at")).alias("pos"), "base").agg(F.sum(F.col("value") * F.col("wt")).alias("value"))
        if scaled:
            found = found.join(diagonal(seqs, kernel), "id").select("id", "pos", "base", (F.col("value") / F.greatest(F.sqrt("k"), F.lit(1e-10))).alias("value"))
    own = seqs.select("id", forward(F.col("seq")).alias("s")).filter(F.length("s") > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("s") - 1)))
    grid = own.withColumn("own", F.substring(F.col("s"), F.col("pos") + 1, F.lit(1))).withColumn("base", F.explode(F.array(*[F.lit(b) for b in BASES])))
    out = grid.select("id", "pos", "base", "own", (F.length("s") < l).alias("short")).join(found, ["id", "pos", "base"], "left")
    value = F.coalesce("value", F.lit(0.0))
    if mode == "importance":
        value = F.when(F.col("base") == F.col("own"), value).otherwise(F.lit(0.0))
    return out.select("id", "pos", "base", F.when(F.col("short"), F.lit(math.nan)).otherwise(value).alias("value"))


def _by_vector(model: GkmModel, seqs: DataFrame, places: DataFrame, match, other, perturb: bool, reach: int) -> DataFrame:
    """RBF kernels: each sequence and support vector has a factor of its own."""
    kernel = model.kernel
    none = math.exp(-kernel.gamma)
    kn = F.col("kn")
    factor = F.when(kn > 0, (F.exp((kn - 1) * kernel.gamma) - none) / kn).otherwise(F.lit(0.0))
    da = diagonal(seqs, kernel).select(F.col("id").alias("a_id"), F.col("k").alias("ka"))
    db = diagonal(model.sv, kernel).select(F.col("id").alias("s_id"), F.col("k").alias("kb"))
    z = F.greatest(F.sqrt(F.col("ka") * F.col("kb")), F.lit(1e-10))
    scale = model.pairs(seqs).join(da, "a_id").join(db, "s_id").select("a_id", "s_id", (F.col("coef") * factor / z).alias("c"))
    theirs = lmers(model.sv, kernel, kernel.include_rc).select(F.col("id").alias("s_id"), F.col("p").alias("q"), F.col("wt").alias("wy"))
    # what each sequence's own support vectors put on each l-mer
    sums = theirs.join(scale, "s_id").groupBy("a_id", "q").agg(F.sum(F.col("c") * F.col("wy")).alias("v"))
    near = close_pairs(places.select("p").distinct(), theirs.select("q").distinct(), kernel.l, reach)
    mine = places.select(F.col("id").alias("a_id"), "p").distinct()
    pairs = mine.join(near, "p").join(sums, ["a_id", "q"])
    shares = _shares(pairs, kernel.l, match, other, perturb, "a_id")
    rows = places.withColumnRenamed("id", "a_id").join(shares, ["a_id", "p"])
    return rows.groupBy(F.col("a_id").alias("id"), (F.col("pos") + F.col("at")).alias("pos"), "base").agg(F.sum(F.col("value") * F.col("wt")).alias("value"))


def completeness(model: GkmModel, seqs: DataFrame) -> DataFrame:
    """id, score - bias (- what is left at kernel 0), and the sum of the importances."""
    rest = model._empty()
    total = explain(model, seqs).groupBy("id").agg(F.sum("value").alias("explained"))
    return model.score(seqs).join(total, "id").select("id", (F.col("score") - F.lit(model.bias + rest)).alias("scored"), "explained")
