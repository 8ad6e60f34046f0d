"""Support vector models: scores, exact l-mer weights, export to a linear k-mer model."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmer_of
from ..functions.tables import Kernel
from ..plans.shared import materialize
from . import local
from .kernel import coefficient, diagonal, keyed, raw_kernel
from .windows import lmers, wanted, weighed, windows


@dataclass
class GkmModel:
    """sv: id, seq, coef. Score f(x) = sum of coef * K(x, sv) + bias."""

    sv: DataFrame
    kernel: Kernel
    bias: float = 0.0

    @property
    def num_support_vectors(self) -> int:
        return self.sv.count()

    @property
    def kernel_params(self) -> dict:
        k = self.kernel
        own = {"L": k.l, "k": k.k, "include_rc": k.include_rc} | ({} if k.d is None else {"d": k.d})
        return own | ({"gamma": k.gamma} if k.rbf else {}) | ({"M": k.M, "H": k.H} if k.weighted else {}) | ({} if k.normalize else {"normalize": False})

    def lmer_sums(self) -> DataFrame:
        """p, v: coefficients summed over the support vectors' l-mers, each divided by the
        root of its self-kernel if the kernel is normalised. Independent of the queries."""
        rows = lmers(self.sv, self.kernel, self.kernel.include_rc).join(self.sv.select("id", "coef"), "id")
        value = F.col("coef") * F.col("wt")
        if self.kernel.normalize:
            rows = rows.join(diagonal(self.sv, self.kernel), "id")
            value = value / F.greatest(F.sqrt("k"), F.lit(1e-10))
        return rows.groupBy("p").agg(F.sum(value).alias("v"))

    def marginals(self) -> DataFrame:
        """t, key, s: sums over all l-mers that agree with the key on subset t."""
        return keyed(self.lmer_sums().select("p", F.col("v").alias("wt")), self.kernel).withColumnRenamed("wt", "s")

    def lmer_weights(self, wanted: DataFrame) -> DataFrame:
        """p, w for the l-mers p in `wanted`: the exact weight of a window in a linear model."""
        keys = keyed(wanted.select("p").distinct().withColumn("wt", F.lit(1.0)), self.kernel, "p")
        found = keys.join(self.marginals(), ["t", "key"])
        return found.groupBy("p").agg(F.sum(coefficient(self.kernel) * F.col("s")).alias("w"))

    def table(self, seqs: DataFrame) -> DataFrame:
        """p, w for the sequences' l-mers, written once."""
        return materialize(self.lmer_weights(wanted(seqs, self.kernel.l)), "lmer-weights")

    def _raw_scores(self, seqs: DataFrame) -> DataFrame:
        return weighed(windows(seqs, self.kernel), self.table(seqs), "id")

    def score(self, seqs: DataFrame) -> DataFrame:
        """id, score of seqs(id, seq); NaN for sequences shorter than l."""
        kernel = self.kernel
        if local.fits(self):
            return local.score(self, seqs)
        if kernel.rbf:
            f = self._rbf(seqs)
        else:
            f = self._raw_scores(seqs)
            if kernel.normalize:
                f = f.join(diagonal(seqs, kernel), "id").select("id", (F.col("f") / F.greatest(F.sqrt("k"), F.lit(1e-10))).alias("f"))
        out = seqs.select("id", (F.length("seq") < kernel.l).alias("short")).join(f, "id", "left")
        return out.select("id", F.when(F.col("short"), F.lit(math.nan)).otherwise(F.coalesce("f", F.lit(self._empty())) + F.lit(self.bias)).alias("score"))

    def _empty(self) -> float:
        """The sum for a sequence that shares nothing with any support vector."""
        if not self.kernel.rbf:
            return 0.0
        return (self.sv.agg(F.sum("coef")).first()[0] or 0.0) * math.exp(-self.kernel.gamma)

    def pairs(self, seqs: DataFrame) -> DataFrame:
        """a_id, s_id, coef, kn: normalised kernel values with the support vectors, where not 0."""
        raw = raw_kernel(seqs, self.sv, self.kernel)
        da = diagonal(seqs, self.kernel).select(F.col("id").alias("a_id"), F.col("k").alias("ka"))
        db = diagonal(self.sv, self.kernel).join(self.sv.select("id", "coef"), "id").select(F.col("id").alias("b_id"), F.col("k").alias("kb"), "coef")
        z = F.greatest(F.sqrt(F.col("ka") * F.col("kb")), F.lit(1e-10)) if self.kernel.normalize or self.kernel.rbf else F.lit(1.0)
        return raw.join(da, "a_id").join(db, "b_id").select("a_id", F.col("b_id").alias("s_id"), "coef", (F.col("k") / z).alias("kn"))

    def _rbf(self, seqs: DataFrame) -> DataFrame:
        """Support vectors that share nothing count with exp(-gamma): start from all of them."""
        gamma, none = self.kernel.gamma, math.exp(-self.kernel.gamma)
        part = F.sum(F.col("coef") * (F.exp((F.col("kn") - 1) * gamma) - none))
        return self.pairs(seqs).groupBy(F.col("a_id").alias("id")).agg((part + F.lit(self._empty())).alias("f"))

    def score_variants(self, ref: DataFrame, alt: DataFrame, method: str = "kernel") -> DataFrame:
        """id, score: f(alt) - f(ref), or with "gkmexplain" the mutation impact."""
        from .effects import mutation_impact, variant_scores

        if method == "gkmexplain":
            return mutation_impact(self, ref, alt)
        if method != "kernel":
            raise ValueError(f"unknown method {method!r}")
        return variant_scores(self, ref, alt)

    def to_deltasvm(self, query_norm: bool = False):
        """A linear model with a weight for each l-mer: the kernel sum on that l-mer alone."""
        from .deltasvm import DeltaSVM

        kernel = self.kernel
        if kernel.l > 14:
            raise ValueError(f"needs l <= 14, got {kernel.l}")
        spark = self.sv.sparkSession
        every = spark.range(4**kernel.l).select("id", kmer_of(F.col("id"), kernel.l).alias("seq"))
        if kernel.rbf or query_norm:
            own = every
            if kernel.include_rc:  # an l-mer and its reverse complement score the same
                from ..functions.sequence import kmer_index, reverse_complement

                own = every.filter(F.col("id") <= kmer_index(reverse_complement(F.col("seq"))))
            w = self.score(own).select("id", (F.col("score") - self.bias).alias("w"))
            if kernel.include_rc:
                seqs = own.join(w, "id")
                w = seqs.select("id", "w").union(seqs.select(kmer_index(reverse_complement(F.col("seq"))), "w")).distinct()
        else:
            wt = windows(every.limit(1), kernel).select("wt")
            scale = float(wt.first()["wt"]) if kernel.weighted else 1.0
            w = every.join(self.lmer_weights(every.select(F.col("id").alias("p"))), F.col("id") == F.col("p"), "left").select("id", (F.coalesce("w", F.lit(0.0)) * scale).alias("w"))
        weights = w.select(kmer_of(F.col("id"), kernel.l).alias("kmer"), "w")
        return DeltaSVM(weights, kernel.l, kernel.l, include_rc=False, bias=self.bias)
