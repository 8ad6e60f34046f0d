"""Genomic loci: windows of a genome, overlaps, chromosome splits, alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize


def chunked(genome: DataFrame, chunk: int, reach: int) -> DataFrame:
    """genome(chrom, seq) in pieces of `chunk` letters that run on by `reach`, so a window
    is found in one piece and no row holds a whole chromosome."""
    rows = genome.select("chrom", "seq", F.length("seq").alias("size")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / chunk).cast("int"))))
    return rows.select("chrom", "size", "piece", F.substring(F.col("seq"), F.col("piece") * chunk + 1, F.lit(chunk + reach)).alias("text"))


def extract(loci: DataFrame, genome: DataFrame, in_window: int = 2114, chroms: list[str] | None = None, summit: bool = True, chunk: int = 1 << 16) -> DataFrame:
    """loci with win_start, seq and kept: the window of `in_window` letters around the summit
    or midpoint. Loci off the chromosome, on others than `chroms` or on none of the genome's
    are not kept (seq null). Other letters read as N."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    centre = F.coalesce(F.col("summit"), middle) if summit and "summit" in loci.columns else middle
    rows = loci.withColumn("win_start", (centre - in_window // 2).cast("long")).withColumn("piece", F.floor(F.col("win_start") / chunk).cast("int"))
    pieces = chunked(genome, chunk, in_window)
    if chroms is not None:
        pieces = pieces.filter(F.col("chrom").isin(chroms))
    out = rows.join(pieces, ["chrom", "piece"], "left")
    inside = (F.col("win_start") >= 0) & (F.col("win_start") + in_window <= F.col("size"))
    text = F.regexp_replace(F.upper(F.substring(F.col("text"), (F.col("win_start") - F.col("piece").cast("long") * chunk + 1).cast("int"), F.lit(in_window))), "[^ACGT]", "N")
    return out.select(*loci.columns, "win_start", F.when(inside, text).alias("seq"), F.coalesce(inside, F.lit(False)).alias("kept"))


def overlapping(left: DataFrame, right: DataFrame, how: str = "left_semi", bin_size: int = 1 << 14) -> DataFrame:
    """Rows of left (chrom, start, end) that overlap a row of right, or that don't
    (left_anti). Intervals are dealt to the bins they touch; a pair meets in its bins only."""
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.greatest("end", F.col("start") + 1) - 1) / bin_size)))
    key = materialize(left, "intervals").withColumn("_id", F.monotonically_increasing_id())
    a = key.select("_id", "chrom", "start", "end").withColumn("bin", bins())
    b = right.select("chrom", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    b = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / bin_size), F.floor((F.greatest("e", F.col("s") + 1) - 1) / bin_size))))
    met = a.join(b, (a["chrom"] == b["chrom"]) & (a["bin"] == b["bin"]) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")), "left_semi")
    return key.join(met.select("_id").distinct(), "_id", how).drop("_id")


def split_chromosomes(loci: DataFrame, test: list[str]) -> tuple[DataFrame, DataFrame]:
    """Training and test loci."""
    held = F.col("chrom").isin(test)
    return loci.filter(~held), loci.filter(held)


def allele_windows(variants: DataFrame, genome: DataFrame, width: int) -> DataFrame:
    """variants(chrom, pos, ref, alt) with ref_seq and alt_seq: the window around pos (from 0)
    with its central letter replaced by each allele."""
    loci = variants.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1).withColumn("summit", F.col("pos"))
    out = extract(loci, genome, width)
    at = F.lit(width // 2 + 1)
    return out.select(*variants.columns, *[F.overlay("seq", F.upper(a), at, F.lit(1)).alias(f"{a}_seq") for a in ("ref", "alt")], "kept")
