"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of fixed size. Blocks are sorted, and equal blocks get one
integer name; then adjacent names are paired and the pairs named in the same way, level by
level, until each document has one name. Two documents have equal names for an equal number
of blocks if and only if their texts are equal: a hash deals the blocks out, but those of
one hash are compared whole, and where they differ each is named by its place among them.

Texts are shuffled once, and a task sends each different block only once, so no task gets
all copies of a text. Rows learn their blocks' names by the hash; only blocks whose hash
others share are looked up whole. Later levels move names only.

Defined results: a null text counts as empty; a text of any length is some more blocks; of
equal texts the row with the largest doc_id stays, and of equal rows (same doc_id and text)
one; a null doc_id is smaller than any other; an empty table gives an empty result; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, sized, without

BLOCK = 8192
BUCKET_BITS, RANK_BITS = 40, 22


def _hash(*columns) -> Column:
    return F.xxhash64(*columns)


def _bucket(hashed) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BUCKET_BITS)


def _cut(docs: DataFrame, size: int) -> DataFrame:
    """docs with `cut`, the text's blocks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return docs.select("doc_id", text.alias("text"), F.when(F.length(text) <= size, F.array(text)).otherwise(cut).alias("cut"))


def block_names(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """hash, base, blocks: the blocks of a hash are named base + 1, base + 2, ... in their
    sorted order. They are listed only if they are several."""
    blocks = _cut(docs, size).select(F.explode("cut").alias("block"))
    found = blocks.groupBy(_hash("block").alias("hash")).agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    several = F.size("blocks") > 1
    found = materialize(found.select("hash", F.size("blocks").alias("m"), F.when(several, F.col("blocks")).alias("blocks")), "dedup-blocks")
    before = F.sum("m").over(W.partitionBy(_bucket("hash")).orderBy("hash")) - F.col("m")
    return found.select("hash", (F.shiftleft(_bucket("hash"), RANK_BITS) + before).alias("base"), "blocks")


def _first_names(docs: DataFrame, size: int) -> DataFrame:
    """rk (a key of the row), doc_id, sha, n (blocks), pos, name."""
    names = materialize(block_names(docs, size), "dedup-names")
    sole, several = names.filter(F.col("blocks").isNull()).drop("blocks"), names.filter(F.col("blocks").isNotNull())
    parts = _cut(docs, size).select(F.monotonically_increasing_id().alias("rk"), "doc_id", F.sha2("text", 256).alias("sha"), "cut")
    rows = parts.select("rk", "doc_id", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("pos", "block"))
    rows = rows.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha"))).withColumn("hash", _hash("block"))
    if several.limit(1).count():  # the place of a block among those of its hash; elsewhere 1
        table = several.select("hash", "base", F.posexplode("blocks").alias("place", "block"))
        rows = rows.join(sized(table), ["hash", "block"], "left").withColumn("own", F.col("base") + F.col("place") + 1).drop("base", "place")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("long"))
    rows = materialize(rows.drop("block"), "dedup-rows")
    return rows.join(sized(sole), "hash", "left").withColumn("name", F.coalesce("own", F.col("base") + 1)).drop("hash", "own", "base")


def _pair_names(pairs: DataFrame) -> DataFrame:
    """left, right, name of the different pairs: their place in the sorted order of the bucket."""
    place = F.dense_rank().over(W.partitionBy("bucket").orderBy("left", "right"))
    rows = pairs.select("left", "right").distinct().withColumn("bucket", _bucket(_hash("left", "right")))
    return rows.select("left", "right", (F.shiftleft("bucket", RANK_BITS) + place).alias("name"))


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """rk (a key of the row), doc_id, sha, n (blocks), name: one row per document."""
    named = materialize(_first_names(docs, block), "dedup-named")
    whole = named.filter("pos = 0").select("rk", "doc_id", "sha", "n")
    done = named.filter("n = 1").select("rk", "name")
    level = named.filter("n > 1").select("rk", "n", "pos", "name")
    most = level.agg(F.max("n")).first()[0] or 1
    while most > 1:
        half = F.col("pos") % 2
        pairs = level.groupBy("rk", ((F.col("n") + 1) / 2).cast("int").alias("n"), (F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right")
        )
        level = materialize(pairs.join(_pair_names(pairs), ["left", "right"]).drop("left", "right"), "dedup-level")
        done = done.unionByName(level.filter("n = 1").select("rk", "name"))
        level = level.filter("n > 1")
        most = (most + 1) // 2
    return whole.join(done, "rk")


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and repeated (the row kept has equal rows)."""
    ids = materialize(identities(docs, block), "dedup-ids")
    last = F.max(F.struct("doc_id", "rk"))
    groups = ids.groupBy("n", "name").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # from a table both sides of the join are plain shuffles, of which Spark can split a large group
    out = ids.join(sized(materialize(groups, "dedup-groups")), ["n", "name"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rk") == F.col("last.rk"))).alias("kept"), F.col("sha").alias("text_sha256"),
        (~alone & (F.col("rk") != F.col("last.rk")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id"))).alias("repeated"),
    )


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that stay, with their own columns."""
    found = materialize(exact_duplicates(docs, block).filter(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("sha"), "repeated"), "dedup-drop")
    return without(docs, found.filter(~F.col("repeated")), found.filter("repeated").distinct())
