"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents queue in a shuffled order that is fixed by the documents
themselves. A copy's virtual finish time is the number of its source's words up to and
including it, divided by the source's target; a source may pass `epochs` times. Copies
are ranged by finish time over all sources and the range is cut where the total budget
is used up.

Nothing is ordered in one task: prefix sums are taken over segments of the shuffled order
and over bins of the finish time first, then within a segment or bin, and sources are
numbered and levelled over range partitions. There are as many segments and bins as the
number of documents asks for. Because a source's queue is cut at one point, the outcome is
a threshold per source and epoch, so texts are not shuffled: each document is decided where
it is read.

Defined results: a null text has size 0; null sources form one source, last in order;
equal rows (same doc_id, source and text) are numbered and queue apart, so some of them may
be taken more often than others; a very long text is one document, so a source may miss its
target by a document's size; documents of size 0 take no words; an empty table gives an
empty result; a source whose documents are all of size 0 has target 0, and its documents
are copied once. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import copy_numbers, materialize, running, sized

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def _place(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _key_columns() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return [
        F.col("doc_id"),
        F.col("source"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("queue"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        digest.alias("digest"),
    ]


def _queued(keyed: DataFrame, equal: DataFrame | None) -> DataFrame:
    """keyed (queue, digest, ...) with h, the place in the queue. `equal` (queue, digest): keys
    of several rows, the second and later of which get places of their own."""
    if equal is None:
        return keyed.withColumn("h", _place(F.col("digest"))).drop("digest")
    alone = keyed.join(sized(equal), ["queue", "digest"], "left_anti").withColumn("h", _place(F.col("digest")))
    several = materialize(keyed.join(sized(equal), ["queue", "digest"], "left_semi"), "mix-equal")
    several = copy_numbers(several, ["queue", "digest"], "nth")
    again = F.md5(F.concat("digest", F.lit(":"), F.col("nth").cast("string")))
    several = several.withColumn("h", _place(F.when(F.col("nth") == 1, F.col("digest")).otherwise(again))).drop("nth")
    return alone.unionByName(several).drop("digest")


def targets(sizes: DataFrame, weights: int = 3, most: int = 3) -> DataFrame:
    """sizes(source, queue, source_size) with weight, target, rank and total. Weights
    1..`weights` repeat over the sources by code point, null last. Targets share the total by
    weight and stop at `most` times a source's size: of the sources ordered by size over
    weight, the first that the common level of the rest doesn't fill fixes that level."""
    ranked = running(sizes.withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), ["last", "source"], "one")
    ranked = (
        ranked.withColumnRenamed("sum_one", "rank").drop("last", "one")
        .withColumn("weight", ((F.col("rank") - 1) % weights + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("room", F.col("cap") / F.col("weight"))
    )
    ranked = materialize(ranked, "mix-ranked")
    sums = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total = sums["total"] or 0
    level = (total - F.col("sum_cap") + F.col("cap")) / (F.lit(sums["weights"] or 0.0) - F.col("sum_weight") + F.col("weight"))
    levels = running(ranked, ["room", "rank"], "cap", "weight").withColumn("level", level)
    low = levels.filter("level <= room").agg(F.min(F.struct("room", "rank", "level")).alias("low")).first()["low"]
    cap = F.col("cap").cast("double")
    target = cap if low is None else F.least(cap, F.lit(low["level"]) * F.col("weight"))
    return ranked.select("source", "queue", "source_size", "weight", "rank", F.lit(total).cast("long").alias("total"), target.alias("target"))


def _equal_keys(keyed: DataFrame) -> DataFrame | None:
    """queue, digest of equal rows; None if there are none."""
    found = materialize(keyed.groupBy("queue", "digest").count().filter("count > 1").select("queue", "digest"), "mix-several")
    return found if found.limit(1).count() else None


def queues(docs: DataFrame, weights: int = 3, epochs: int = 3) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The queued documents (doc_id, queue, size, h); a row per source: target and, for each
    epoch, the largest place whose copy is taken (cut_1, ...); the keys of equal rows."""
    keyed = materialize(docs.select(*_key_columns()), "mix-keys")
    equal = _equal_keys(keyed)
    base = _queued(keyed, equal)
    base = base if equal is None else materialize(base, "mix-queued")
    n = keyed.count()
    shift = HASH_BITS - int(n**0.5).bit_length()  # as many segments as rows in one, for a source that is all
    segments = base.groupBy("queue", F.shiftright("h", shift).alias("segment")).agg(F.min("source").alias("source"), F.sum("size").alias("part"))
    before = W.partitionBy("queue").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    segments = materialize(segments.withColumn("before", F.coalesce(F.sum("part").over(before), F.lit(0))), "mix-segments")
    sources = materialize(targets(segments.groupBy("queue").agg(F.min("source").alias("source"), F.sum("part").alias("source_size")), weights), "mix-targets")

    finish = (
        base.filter("size > 0").select("queue", "h", "size", F.shiftright("h", shift).alias("segment"))
        .join(segments.select("queue", "segment", "before"), ["queue", "segment"])
        .withColumn("upto", F.col("before") + F.sum("size").over(W.partitionBy("queue", "segment").orderBy("h")))
        .join(sized(sources.filter("target > 0").select("queue", "rank", "source_size", "target")), "queue")
    )
    finish = materialize(finish.select("queue", "rank", "h", "size", "upto", "source_size", "target"), "mix-finish")

    head = sources.agg(F.max("total").alias("total")).first()
    budget = (head and head["total"]) or 0
    bins = max(256, int(n**0.5))
    copies = finish.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("finish", ((F.col("epoch") - 1) * F.col("source_size") + F.col("upto")) / F.col("target"))
    copies = copies.withColumn("bin", F.least(F.floor(F.col("finish") * bins), F.lit(epochs * bins)).cast("long"))
    over = running(copies.groupBy("bin").agg(F.sum("size").alias("part")), "bin", "part").filter(F.col("sum_part") > budget).orderBy("bin").limit(1).collect()
    last, used = (over[0]["bin"], over[0]["sum_part"] - over[0]["part"]) if over else (epochs * bins + 1, 0)
    at = F.struct("finish", "rank")
    # copies of equal finish and rank have equal places: they are cut together
    edges = running(copies.filter(F.col("bin") == last).groupBy("finish", "rank").agg(F.sum("size").alias("size")), ["finish", "rank"], "size")
    edge = edges.filter(F.col("sum_size") + F.lit(used) <= budget).agg(F.max(at).alias("at")).first()["at"]
    taken = F.col("bin") < last
    if edge is not None:
        taken = taken | ((F.col("bin") == last) & (at <= F.struct(F.lit(edge["finish"]).alias("finish"), F.lit(edge["rank"]).alias("rank"))))
    cuts = copies.filter(taken).groupBy("queue").agg(*[F.max(F.when(F.col("epoch") == e, F.col("h"))).alias(f"cut_{e}") for e in range(1, epochs + 1)])
    return base, sized(materialize(sources.join(cuts, "queue", "left"), "mix-cuts")), equal


def _copies(epochs: int):
    cut = sum((F.coalesce((F.col("h") <= F.col(f"cut_{e}")).cast("long"), F.lit(0)) for e in range(1, epochs + 1)), F.lit(0).cast("long"))
    return F.when(F.col("target") > 0, cut).otherwise(F.lit(1).cast("long"))


def mix(docs: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies."""
    base, cuts, _ = queues(docs, weights, epochs)
    out = base.drop("source").join(cuts, "queue").withColumn("copies", _copies(epochs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: int = 3, epochs: int = 3) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    _, cuts, equal = queues(docs, weights, epochs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key_columns()).select("row", "queue", "digest")
    rows = _queued(rows, equal)
    out = rows.join(cuts.select("queue", "target", *[f"cut_{e}" for e in range(1, epochs + 1)]), "queue").withColumn("copies", _copies(epochs))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
