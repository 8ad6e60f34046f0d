"""Linear (gapped) k-mer models: a weight per k-mer."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmer_index, reverse_complement
from ..functions.tables import Kernel
from ..plans.shared import materialize
from .windows import packed, wanted, weighed


@dataclass
class DeltaSVM:
    """weights: kmer, w. Windows have l letters; with k < l each window counts all k-mers
    that its positions, taken k at a time in order, spell."""

    weights: DataFrame
    l: int
    k: int
    include_rc: bool = True
    bias: float = 0.0

    @property
    def num_kmers(self) -> int:
        return self.weights.filter("w <> 0").count()

    def table(self, seqs: DataFrame) -> DataFrame:
        """p, w: what a window of l letters adds, of all k-mers that it spells and, with
        include_rc, of those that its reverse complement does."""
        kmer = F.col("kmer")
        weights = self.weights.select(kmer_index(kmer).alias("q"), "w")
        if self.include_rc:
            # positions of the reverse complement are the same ones in reverse: all are taken
            weights = weights.union(self.weights.select(kmer_index(reverse_complement(kmer)), "w")).groupBy("q").agg(F.sum("w").alias("w"))
        if self.k == self.l:
            return materialize(weights.select(F.col("q").alias("p"), "w"), "kmer-table")
        digit = lambda i: F.shiftright("p", 2 * (self.l - 1 - i)).bitwiseAND(F.lit(3))
        picks = [sum((F.shiftleft(digit(i), 2 * (self.k - 1 - j)) for j, i in enumerate(c)), F.lit(0).cast("long")) for c in combinations(range(self.l), self.k)]
        rows = wanted(seqs, self.l).select("p", F.explode(F.array(*picks)).alias("q"))
        return materialize(rows.join(weights, "q").groupBy("p").agg(F.sum("w").alias("w")), "kmer-table")

    def score(self, seqs: DataFrame) -> DataFrame:
        """id, score; the bias alone for sequences shorter than l."""
        f = weighed(packed(seqs, self.l).withColumn("wt", F.lit(1.0)), self.table(seqs), "id")
        return seqs.select("id").join(f, "id", "left").select("id", (F.coalesce("f", F.lit(0.0)) + F.lit(self.bias)).alias("score"))

    def score_variants(self, ref: DataFrame, alt: DataFrame) -> DataFrame:
        """id, score: of the windows that differ."""
        from .effects import allele_lmers

        plain = Kernel(0, self.l, self.k, None, normalize=False)
        change = materialize(allele_lmers(ref, alt, plain), "changes")
        f = weighed(change, self.table(ref.select("id", "seq").unionByName(alt.select("id", "seq"))), "id")
        return ref.select("id").join(alt.select("id"), "id").join(f, "id", "left").select("id", F.coalesce("f", F.lit(0.0)).alias("score"))

    def polya_floor(self) -> DeltaSVM:
        """Weights of the all-A and all-T l-mers set to minus the bias, as the external
        deltaSVM script reads them."""
        flat = F.col("kmer").isin("A" * self.k, "T" * self.k)
        return DeltaSVM(self.weights.select("kmer", F.when(flat, F.lit(-self.bias)).otherwise(F.col("w")).alias("w")), self.l, self.k, self.include_rc, self.bias)


def ensemble(models: list[DeltaSVM]) -> DeltaSVM:
    """The mean of several weight tables; a k-mer that one lacks counts 0 there."""
    rows = models[0].weights
    for m in models[1:]:
        rows = rows.unionByName(m.weights)
    first = models[0]
    mean = rows.groupBy("kmer").agg((F.sum("w") / len(models)).alias("w"))
    return DeltaSVM(mean, first.l, first.k, first.include_rc, sum(m.bias for m in models) / len(models))
