"""What the corpus operators share: tables, joins on documents' keys, worker caches."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.prefix import running
from ..plans.shared import drop, materialize, scratch, shared_dir, sized

__all__ = ["LONGEST", "copy_numbers", "drop", "materialize", "running", "scratch", "shared_dir", "sized", "table", "without", "worker_cache"]

#: Workers remember what belongs to chunks of at most so many characters, so that a cache
#: bounded in entries is bounded in bytes.
LONGEST = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key: tuple, make):
    """make(), remembered as long as the Python worker lives and asks for the same key: a
    worker holds what one operator remembers, not what all of a pipeline do."""
    held = sys.modules.setdefault("_helixframe_worker", types.ModuleType("_helixframe_worker")).__dict__
    if held.get("key") != key:
        held.pop("value", None)
        held["value"], held["key"] = make(), key
    return held["value"]


def copy_numbers(rows: DataFrame, group: list[str], name: str = "copy", share: int = 1 << 16) -> DataFrame:
    """rows with consecutive numbers from 1 within each group of rows, in any order. A group
    is dealt to tasks in parts of about `share` rows, whose sizes are summed up, so no task
    gets all of a large one. `rows` should be a stored table, read alike each time."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / share).alias("_parts"))
    row = F.monotonically_increasing_id()
    dealt = materialize(rows.withColumn("_row", row).join(sized(sizes), group).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts"), "copies")
    parts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")
    place = F.row_number().over(W.partitionBy(*group, "_part").orderBy("_row"))
    out = dealt.withColumn(name, place).join(sized(parts.withColumn("_before", before).drop("_n")), [*group, "_part"])
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_row", "_part", "_before")


def without(docs: DataFrame, drop: DataFrame, single: DataFrame) -> DataFrame:
    """Rows of docs but those whose (doc_id, text) is in drop (doc_id, sha); of the equal
    rows named in single (doc_id, sha), one. Texts are moved only if the keys are too many
    to broadcast."""
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("k1"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("k2"))

    def pick(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = sized(keys.select(F.col("doc_id").alias("d1"), F.col("sha").alias("d2")))
        return rows.join(keys, F.col("k1").eqNullSafe(F.col("d1")) & (F.col("k2") == F.col("d2")), how)

    kept = pick(keyed, drop, "left_anti")
    if single.limit(1).count():
        kept = pick(kept, single, "left_anti").unionByName(pick(keyed, single, "left_semi").dropDuplicates(["k1", "k2"]))
    return kept.select("row.*")
