"""Metrics, agreement, matched sampling and other tables around models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.prefix import running
from ..plans.shared import materialize, sized


def _levels(rows: DataFrame, score: str, label: str) -> DataFrame:
    """A row per distinct score: positives, negatives, and both up to and including it."""
    up = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    counts = up.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))
    return running(counts, "s", "pos", "neg")


def auroc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve; ties count a half."""
    out = _levels(rows, score, label)
    below = F.col("sum_neg") - F.col("neg") / 2
    return out.agg((F.sum(F.col("pos") * below) / F.sum("pos") / F.sum("neg")).alias("auroc"))


def average_precision(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision at each distinct score, weighted by the recall it adds."""
    out = _levels(rows.withColumn("_s", -F.col(score)), "_s", label)
    precision = F.col("sum_pos") / (F.col("sum_pos") + F.col("sum_neg"))
    return out.agg((F.sum(F.col("pos") * precision) / F.sum("pos")).alias("average_precision"))


def ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """column, name: mean rank of each distinct value."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, column, "n").select(column, (F.col("sum_n") - (F.col("n") - 1) / 2).alias(name))


def correlations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """pearson, spearman."""
    rows = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    both = rows.join(ranks(rows, "a", "ra"), "a").join(ranks(rows, "b", "rb"), "b")
    return both.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def agreement(rows: DataFrame, a: str, b: str, floor: float = 1e-3) -> DataFrame:
    """n, largest absolute and relative difference (where |b| is at least the floor), corr."""
    gap = F.abs(F.col(a) - F.col(b))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_abs"),
        F.max(F.when(F.abs(b) >= floor, gap / F.abs(b))).alias("max_rel"), F.corr(a, b).alias("corr"),
    )


def draw(key: str | Column, seed: int = 0) -> Column:
    """A number below 2 ** 52, the same wherever it is drawn for the same key and seed."""
    name = F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))
    return F.conv(F.substring(name, 1, 13), 16, 10).cast("long")


def drawn(pool: DataFrame, want: DataFrame, stratum: list[str], key: str = "id", seed: int = 0) -> DataFrame:
    """From pool, `want` rows of each stratum, those with the smallest draws. Rows are ranked
    among those whose draws are below what gives a few more than wanted, so a large stratum
    isn't ordered in one task; should some stratum come short of it, all its rows are."""
    sizes = pool.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_n"))
    strata = materialize(want.join(sizes, stratum).withColumn("_want", F.least("want", "_n")).drop("want"), "strata")
    likely = (F.col("_want") + F.sqrt("_want") * 6 + 20) / F.col("_n") * F.lit(float(1 << 52))
    rows = pool.join(sized(strata), stratum).withColumn("_draw", draw(key, seed))
    near = rows.filter(F.col("_draw") < likely)
    order = W.partitionBy(*stratum).orderBy("_draw", key)
    pick = lambda some: some.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= F.col("_want")).select(*pool.columns)
    short = strata.join(near.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_got")), stratum, "left").filter(F.coalesce("_got", F.lit(0)) < F.col("_want"))
    return pick(rows if short.limit(1).count() else near)


def matched_sample(pool: DataFrame, like: DataFrame, stratum: list[str], key: str = "id", seed: int = 0, fill: bool = True) -> DataFrame:
    """From pool, as many rows of each stratum as `like` has, in an order fixed by the seed;
    with `fill`, strata that run short are made up from the rest of the pool."""
    picked = drawn(pool, like.groupBy(*stratum).agg(F.count(F.lit(1)).alias("want")), stratum, key, seed)
    if not fill:
        return picked
    picked = materialize(picked, "matched")
    missing = like.count() - picked.count()
    return picked.unionByName(subsample(pool.join(picked.select(key), key, "left_anti"), max(0, missing), key, seed))


def gc_bin(seq: Column, bins: int = 20) -> Column:
    share = F.length(F.regexp_replace(F.upper(seq), "[^GC]", "")) / F.greatest(F.length(seq), F.lit(1))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def subsample(rows: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, fixed by the seed."""
    return rows.orderBy(draw(key, seed), key).limit(n)


def subset_vectors(sv: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n support vectors, with the share of positive coefficients kept."""
    total, positive = sv.agg(F.count(F.lit(1)), F.count_if(F.col("coef") > 0)).first()
    take = round(n * positive / total) if total else 0
    want = sv.sparkSession.createDataFrame([(True, take), (False, n - take)], "_sign boolean, want long")
    return drawn(sv.withColumn("_sign", F.col("coef") > 0), want, ["_sign"], "id", seed).drop("_sign")


def top_positions(attributions: DataFrame, n: int) -> DataFrame:
    """The n positions of each sequence that weigh most."""
    order = W.partitionBy("id").orderBy(F.desc(F.abs("value")), "pos", "base")
    return attributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def sum_scores(scores: list[DataFrame]) -> DataFrame:
    """Several models' scores of the same sequences, added up."""
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return out.groupBy("id").agg(F.sum("score").alias("score"))


def best_effect(variants: DataFrame, effects: DataFrame, on: list[str], p: str = "p") -> DataFrame:
    """Each variant with the effect of the smallest p at its place, if there is one."""
    order = W.partitionBy(*on).orderBy(p, *[c for c in effects.columns if c not in (*on, p)])
    best = effects.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    return variants.join(best, on, "left")


def allele_mismatch(rows: DataFrame, seq: str, allele: str, pos: Column) -> DataFrame:
    """Share of sequences whose letter at pos isn't the allele."""
    return rows.agg(F.avg((F.upper(F.substring(F.col(seq), pos + 1, F.lit(1))) != F.upper(allele)).cast("double")).alias("mismatch"))


def variant_evaluation(rows: DataFrame, score: str = "score", significant: str = "significant", effect: str | None = None, flip: bool = False) -> DataFrame:
    """auroc and average precision of |score| for significant variants against controls, and
    the correlations with known effects of the significant ones."""
    used = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_size", F.abs(score)).withColumn("_label", F.col(significant).cast("int"))
    out = auroc(used, "_size", "_label").crossJoin(average_precision(used, "_size", "_label"))  # one row each
    if effect:
        known = used.filter(F.col(significant) & F.col(effect).isNotNull()).withColumn("_e", -F.col(effect) if flip else F.col(effect))
        out = out.crossJoin(correlations(known, score, "_e"))
    return out


def longest_prefix(names: DataFrame, dictionary: DataFrame, name: str = "name", prefix: str = "prefix") -> DataFrame:
    """Each name with the longest dictionary entry that starts it: one equi-join per length
    that occurs in the dictionary, not a theta join."""
    sizes = [r[0] for r in dictionary.select(F.length(prefix)).distinct().collect()]  # as many as lengths
    cut = names.withColumn("_try", F.explode(F.array(*[F.substring(name, 1, n) for n in sorted(sizes)])))
    hits = cut.join(dictionary.withColumnRenamed(prefix, "_try"), "_try")
    best = hits.groupBy(name).agg(F.max_by(F.struct(*dictionary.columns[:0], "_try", *[c for c in dictionary.columns if c != prefix]), F.length("_try")).alias("_b"))
    return names.join(best, name, "left").select(*names.columns, F.col("_b._try").alias(prefix), *[F.col(f"_b.{c}") for c in dictionary.columns if c != prefix])
