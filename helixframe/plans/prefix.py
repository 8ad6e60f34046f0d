"""Running sums over a global order, by range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize


def running(df: DataFrame, order: str | list[str], *columns: str) -> DataFrame:
    """df with sum_<column>: sums over all rows up to and including each, by ascending order,
    which should have no ties. Rows are range-partitioned; a partition's rows are summed in
    their task and shifted by the totals of the partitions before it, of which there are as
    many as tasks."""
    order = [order] if isinstance(order, str) else order
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_before_{c}") for c in columns])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_before_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(totals), "_range")  # a row per task
    return out.select(*df.columns, *[(F.col(f"_before_{c}") + F.sum(c).over(within)).alias(f"sum_{c}") for c in columns])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "id") -> DataFrame:
    """df with consecutive numbers from 0: by the order of the groups, then within each."""
    sizes = running(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group, "_n")
    sizes = sizes.select(*group, (F.col("sum__n") - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.join(sizes, group).withColumn(name, (F.col("_before") + place - 1).cast("long")).drop("_before")
