"""In-silico mutagenesis, variant scores and mutation impact.

A changed sequence is its reference plus a few windows less a few: the l-mers around the
change, with signed weights. Raw sums change by what these add. As kernels are bilinear in
the l-mers, a self-kernel changes by K(x + d, x + d) - K(x, x) = 2 K(x, d) + K(d, d). So
whatever the length of the sequences, only the windows that a change touches are made anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, DIGITS, forward
from ..functions.tables import Kernel
from ..plans.shared import materialize
from . import local
from .kernel import against, diagonal, raw_kernel, raw_of
from .windows import ALL_LMERS, lmers, packed, weighed, weight

FLOOR = 1e-10


def mutants(seqs: DataFrame) -> DataFrame:
    """id, pos, base, seq of every single-letter change."""
    rows = seqs.select("id", forward(F.col("seq")).alias("s")).filter(F.length("s") > 0)
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("s") - 1)))
    rows = rows.withColumn("base", F.explode(F.array(*[F.lit(b) for b in BASES]))).withColumn("own", F.substring(F.col("s"), F.col("pos") + 1, F.lit(1)))
    return rows.filter("base <> own").select("id", "pos", "base", F.overlay("s", "base", F.col("pos") + 1, F.lit(1)).alias("seq"))


def mutant_lmers(seqs: DataFrame, kernel: Kernel) -> DataFrame:
    """id (sequence, pos, base), of (the sequence), p, wt: what each single-letter change takes
    from the sequence's l-mers (wt below 0) and adds to them."""
    l = kernel.l
    rows = packed(seqs, l).withColumn("wt", weight(kernel, F.col("pos"), F.col("n"))).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(l - 1))))
    shift = (F.lit(l - 1) - F.col("at")) * 2
    rows = rows.withColumn("own", F.call_function("shiftright", "p", shift).bitwiseAND(F.lit(3))).withColumn("letter", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("letter <> own")
    new = F.col("p") + F.call_function("shiftleft", F.col("letter").cast("long") - F.col("own"), shift)
    base = F.element_at(F.array(*[F.lit(b) for b in BASES]), F.col("letter") + 1)
    name = F.struct(F.col("id").alias("id"), (F.col("pos") + F.col("at")).cast("int").alias("pos"), base.alias("base"))
    both = F.array(F.struct(F.col("p").alias("p"), (-F.col("wt")).alias("wt")), F.struct(new.alias("p"), F.col("wt").alias("wt")))
    return _summed(rows.select(name.alias("id"), F.col("id").alias("of"), F.inline(both)))


def allele_lmers(ref: DataFrame, alt: DataFrame, kernel: Kernel) -> DataFrame:
    """id, of, p, wt: what the alternative sequence of an id takes and adds, substitutions and
    insertions alike. Windows outside the part between the longest common beginning and end are
    the same, but where windows weigh by their place in sequences of unequal lengths."""
    rows = ref.select("id", forward(F.col("seq")).alias("r")).join(alt.select("id", forward(F.col("seq")).alias("a")), "id")

    def common(x: Column, y: Column) -> Column:
        unequal = F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: ~a.eqNullSafe(b))
        at = F.array_position(unequal, True).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.greatest(F.length(x), F.length(y)))

    shorter = F.least(F.length("r"), F.length("a"))
    moved = F.lit(kernel.weighted) & (F.length("r") != F.length("a"))
    rows = rows.filter("r <> a").withColumn("begin", F.when(moved, 0).otherwise(common(F.col("r"), F.col("a"))))
    rows = rows.withColumn("end", F.when(moved, 0).otherwise(F.least(common(F.reverse("r"), F.reverse("a")), shorter - F.col("begin"))))
    rows = rows.withColumn("lo", F.greatest(F.col("begin") - (kernel.l - 1), F.lit(0)))

    def part(name: str, sign: float) -> DataFrame:
        hi = F.least(F.length(name) - F.col("end") + (kernel.l - 1), F.length(name))
        cut = rows.select("id", "lo", (F.length(name) - (kernel.l - 1)).alias("total"), F.substring(F.col(name), F.col("lo") + 1, hi - F.col("lo")).alias("seq"))
        wt = weight(kernel, F.col("pos") + F.col("lo"), F.col("total")) * sign
        return packed(cut, kernel.l, "lo", "total").select("id", F.col("id").alias("of"), "p", wt.alias("wt"))

    return _summed(part("r", -1.0).unionByName(part("a", 1.0)))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "of", "p").agg(F.sum("wt").alias("wt")).filter("wt <> 0")


def _reversed(p: Column, l: int) -> Column:
    """The packed reverse complement."""
    return F.conv(F.reverse(F.translate(F.lpad(F.conv(p.cast("string"), 10, 4), l, "0"), DIGITS, DIGITS[::-1])), 4, 10).cast("long")


def _weights(model, rows: DataFrame) -> DataFrame:
    """p, w for the rows' l-mers."""
    l = model.kernel.l
    p = rows.sparkSession.range(4**l).select(F.col("id").alias("p")) if 4**l <= ALL_LMERS else rows.select("p").distinct()
    return materialize(model.lmer_weights(p), "lmer-weights")


def _norms(model, seqs: DataFrame, items: DataFrame, change: DataFrame) -> DataFrame:
    """id, of, ka, kb: self-kernels before and after the change."""
    kernel = model.kernel
    diag = diagonal(seqs, kernel).select(F.col("id").alias("of"), F.col("k").alias("ka"))
    own = against(change.select(F.col("of").alias("id"), "p").distinct(), lmers(seqs, kernel, kernel.include_rc), kernel)
    cross = change.join(own.select(F.col("id").alias("of"), "p", "v"), ["of", "p"]).groupBy("id").agg((2 * F.sum(F.col("wt") * F.col("v"))).alias("d"))
    both = change.select("id", "p", "wt")
    if kernel.include_rc:
        both = both.unionByName(change.select("id", _reversed(F.col("p"), kernel.l).alias("p"), "wt"))
    square = raw_of(change.select("id", "p", "wt"), both, kernel, "brute", same=True).select(F.col("a_id").alias("id"), F.col("k").alias("d"))
    total = cross.unionByName(square).groupBy("id").agg(F.sum("d").alias("d"))
    return items.join(diag, "of", "left").join(total, "id", "left").select("id", "of", F.coalesce("ka", F.lit(0.0)).alias("ka"), F.greatest(F.coalesce("ka", F.lit(0.0)) + F.coalesce("d", F.lit(0.0)), F.lit(0.0)).alias("kb"))


def _root(k) -> Column:
    return F.greatest(F.sqrt(k), F.lit(FLOOR))


def _pairs(model, seqs: DataFrame, items: DataFrame, change: DataFrame) -> DataFrame:
    """id, of, s_id, coef, ks, old, new: raw kernels with the support vectors before and after,
    where either isn't 0."""
    kernel = model.kernel
    before = raw_kernel(seqs, model.sv, kernel).select(F.col("a_id").alias("of"), F.col("b_id").alias("s_id"), F.col("k").alias("old"))
    before = items.select("id", "of").join(before, "of").select("id", "s_id", "old", F.col("old").alias("new"))
    moved = raw_of(change.select("id", "p", "wt"), lmers(model.sv, kernel, kernel.include_rc), kernel)
    moved = moved.select(F.col("a_id").alias("id"), F.col("b_id").alias("s_id"), F.lit(0.0).alias("old"), F.col("k").alias("new"))
    both = before.unionByName(moved).groupBy("id", "s_id").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    vectors = diagonal(model.sv, kernel).select(F.col("id").alias("s_id"), F.col("k").alias("ks")).join(model.sv.select(F.col("id").alias("s_id"), "coef"), "s_id")
    return both.join(vectors, "s_id")


def differences(model, seqs: DataFrame, items: DataFrame, change: DataFrame) -> DataFrame:
    """id, value = f(changed) - f(sequence), each under its own norm. items: id, of (the id in
    seqs of what is changed); change: id, of, p, wt."""
    kernel = model.kernel
    change = materialize(change, "changes")
    zero = F.lit(0.0)
    if not kernel.rbf:
        moved = weighed(change, _weights(model, change), "id").withColumnRenamed("f", "d")
        if not kernel.normalize:
            return items.join(moved, "id", "left").select("id", F.coalesce("d", zero).alias("value"))
        raw = model._raw_scores(seqs).select(F.col("id").alias("of"), "f")
        rows = _norms(model, seqs, items, change).join(raw, "of", "left").join(moved, "id", "left")
        f, d = F.coalesce("f", zero), F.coalesce("d", zero)
        return rows.select("id", ((f + d) / _root("kb") - f / _root("ka")).alias("value"))
    norms = _norms(model, seqs, items, change)
    rows = _pairs(model, seqs, items, change).join(norms, "id")
    radial = lambda k, own: F.exp((F.col(k) / F.greatest(F.sqrt(F.col(own) * F.col("ks")), F.lit(FLOOR)) - 1) * kernel.gamma)
    value = F.sum(F.col("coef") * (radial("new", "kb") - radial("old", "ka")))
    return items.select("id").join(rows.groupBy("id").agg(value.alias("value")), "id", "left").select("id", F.coalesce("value", zero).alias("value"))


def ism(model, seqs: DataFrame) -> DataFrame:
    """id, pos, base, value = f(mutant) - f(sequence), each with its own norm; 0 at the
    sequence's own base, NaN for sequences shorter than l."""
    if local.fits(model):
        return local.ism(model, seqs)
    l = model.kernel.l
    letters = seqs.select("id", forward(F.col("seq")).alias("s")).filter(F.length("s") > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("s") - 1)))
    letters = letters.select("id", "pos", F.substring(F.col("s"), F.col("pos") + 1, F.lit(1)).alias("own"), (F.length("s") < l).alias("short"), F.explode(F.array(*[F.lit(b) for b in BASES])).alias("base"))
    changed = letters.filter("base <> own and not short").select(F.struct("id", "pos", "base").alias("id"), F.col("id").alias("of"))
    value = differences(model, seqs, changed, mutant_lmers(seqs, model.kernel)).select("id.*", "value")
    same = letters.filter("base = own or short").select("id", "pos", "base", F.when(F.col("short"), F.lit(math.nan)).otherwise(F.lit(0.0)).alias("value"))
    return value.unionByName(same)


def _with_short(rows: DataFrame, ref: DataFrame, alt: DataFrame, l: int) -> DataFrame:
    """id, score: rows(id, value), NaN where either sequence is shorter than l."""
    sizes = ref.select("id", F.length("seq").alias("a")).join(alt.select("id", F.length("seq").alias("b")), "id")
    return sizes.join(rows, "id", "left").select("id", F.when((F.col("a") < l) | (F.col("b") < l), F.lit(math.nan)).otherwise(F.coalesce("value", F.lit(0.0))).alias("score"))


def variant_scores(model, ref: DataFrame, alt: DataFrame) -> DataFrame:
    """id, score = f(alt) - f(ref)."""
    if local.fits(model):
        changed = model.score(alt).withColumnRenamed("score", "changed")
        return model.score(ref).join(changed, "id").select("id", (F.col("changed") - F.col("score")).alias("score"))
    items = ref.select("id", F.col("id").alias("of"))
    return _with_short(differences(model, ref, items, allele_lmers(ref, alt, model.kernel)), ref, alt, model.kernel.l)


def mutation_impact(model, ref: DataFrame, alt: DataFrame) -> DataFrame:
    """id, score: kernel differences to each support vector under the reference's norm; for
    RBF kernels spread by the radial function's mean slope at the reference's value."""
    kernel = model.kernel
    change = materialize(allele_lmers(ref, alt, kernel), "changes")
    diag = diagonal(ref, kernel).select("id", F.col("k").alias("ka"))
    if kernel.rbf:
        rows = _pairs(model, ref, ref.select("id", F.col("id").alias("of")), change).join(diag, "id")
        z = F.greatest(F.sqrt(F.col("ka") * F.col("ks")), F.lit(FLOOR))
        k, new = F.col("old") / z, F.col("new") / z
        slope = (F.exp((k - 1) * kernel.gamma) - math.exp(-kernel.gamma)) / k
        rows = rows.groupBy("id").agg(F.sum(F.col("coef") * F.when(k > 0, (new - k) * slope).otherwise(F.lit(0.0))).alias("value"))
    else:
        rows = weighed(change, _weights(model, change), "id").withColumnRenamed("f", "value")
        if kernel.normalize:
            rows = rows.join(diag, "id").select("id", (F.col("value") / _root("ka")).alias("value"))
    return _with_short(rows, ref, alt, kernel.l)
