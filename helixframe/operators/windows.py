"""Windows (l-mers) of sequences as rows: id, pos, p (packed, first base most significant)
and wt. Sequences shorter than l have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import DIGITS, forward, reverse_complement
from ..functions.tables import Kernel
from ..plans.shared import sized, spread

#: A sequence is cut in chunks, in one pass, before it is cut in windows, as taking a
#: substring costs as much as its place in the string.
CHUNK = 64
#: Bytes of a table of l-mer weights that may be broadcast.
TABLE_BYTES = 256 << 20
#: Tables are made for all l-mers if these are so few, else for those that occur.
ALL_LMERS = 1 << 18


def weight(kernel: Kernel, pos: Column, n: Column) -> Column:
    if not kernel.weighted:
        return F.lit(1.0)
    far = F.abs(F.floor(n / 2) - pos)
    return F.least(F.lit(float(kernel.M)), F.floor(F.exp(far * F.lit(-0.6931471805599453 / kernel.H)) * kernel.M + 1).cast("double"))


def _cut(seqs: DataFrame, text: Column, l: int, *keep: str) -> DataFrame:
    """id, n (windows of the sequence), at, s (chunk), i (place in it, from 1), by window."""
    # sequences without windows go with their chunk: a filter here would make the text twice
    rows = spread(seqs.select("id", *keep, text.alias("s"))).withColumn("n", F.length("s") - l + 1)
    overlapping = F.lit(f"(?s)(?=(.{{1,{CHUNK + l - 1}}})).{{1,{CHUNK}}}")
    rows = rows.select("id", *keep, "n", F.posexplode(F.regexp_extract_all("s", overlapping, F.lit(1))).alias("at", "s")).filter(F.length("s") >= l)
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s") - l + 1)))


def kmers(seqs: DataFrame, l: int, strand: str = "+", *keep: str) -> DataFrame:
    """id, pos, n (windows of the sequence) and kmer, in the strand's own direction."""
    rows = _cut(seqs, forward(F.col("seq")) if strand == "+" else reverse_complement(F.col("seq")), l, *keep)
    return rows.select("id", *keep, (F.col("at") * CHUNK + F.col("i") - 1).alias("pos"), "n", F.substring(F.col("s"), F.col("i"), F.lit(l)).alias("kmer"))


def _packed(seqs: DataFrame, text: Column, l: int, *keep: str) -> DataFrame:
    rows = _cut(seqs, F.translate(text, "ACGT", DIGITS), l, *keep)
    return rows.select("id", *keep, "n", (F.col("at") * CHUNK + F.col("i") - 1).alias("pos"), F.conv(F.substring(F.col("s"), F.col("i"), F.lit(l)), 4, 10).cast("long").alias("p"))


def windows(seqs: DataFrame, kernel: Kernel, strand: str = "+", *keep: str) -> DataFrame:
    """A reverse-strand window carries the weight of the window it comes from."""
    rows = _packed(seqs, forward(F.col("seq")) if strand == "+" else reverse_complement(F.col("seq")), kernel.l, *keep)
    source = F.col("pos") if strand == "+" else F.col("n") - 1 - F.col("pos")
    return rows.select("id", *keep, "pos", "p", weight(kernel, source, F.col("n")).alias("wt"))


def packed(seqs: DataFrame, l: int, *keep: str) -> DataFrame:
    """id, n (windows of the sequence), pos, p of the forward windows."""
    return _packed(seqs, forward(F.col("seq")), l, *keep)


def wanted(seqs: DataFrame, l: int) -> DataFrame:
    """p: every l-mer that a table of weights for the sequences needs."""
    if 4**l <= ALL_LMERS:
        return seqs.sparkSession.range(4**l).select(F.col("id").alias("p"))
    return packed(seqs, l).select("p").distinct()


def weighed(rows: DataFrame, table: DataFrame, *group: str) -> DataFrame:
    """group, f: the windows' weights (wt) times those of their l-mers in table(p, w), summed.
    The table is broadcast if its size allows: then windows are summed where they are made,
    and a row per group and task is all that is shuffled."""
    return rows.join(sized(table.select("p", "w"), TABLE_BYTES), "p").groupBy(*group).agg(F.sum(F.col("wt") * F.col("w")).alias("f"))


def lmers(seqs: DataFrame, kernel: Kernel, both: bool = False) -> DataFrame:
    """id, p, wt: distinct l-mers of each sequence with their summed weights, so that repeats
    and low-complexity stretches are one row. `both`: of both strands."""
    rows = windows(seqs, kernel)
    if both:
        rows = rows.unionByName(windows(seqs, kernel, "-"))
    return rows.groupBy("id", "p").agg(F.sum("wt").alias("wt"))
