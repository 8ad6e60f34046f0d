"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if its rows come to at most so many bytes.
BROADCAST_BYTES = 16 << 20
#: Bytes that any row has at least.
ROW_BYTES = 16

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all runs on one machine;
    on a cluster, whose machines share no such folder, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        where = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Written as Parquet and read again: the lineage ends here, and a lost executor costs no
    recomputation. `scratch` deletes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized within are deleted at the end: to be put around the action that
    uses them up, such as writing a query's result."""
    first = len(_written)
    try:
        yield
    finally:
        while len(_written) > first:
            drop(spark, _written.pop())


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast only if its rows, measured as JSON, come to at most `most` bytes."""
    if df.count() * ROW_BYTES > most:
        return df
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + ROW_BYTES
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


#: A table of fewer bytes a core is dealt out to all of them: it may be one file of one row
#: group, which a single task would read.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is so small that moving it costs little; larger tables
    have tasks enough. To be put before work that makes many rows of each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if known < cores * SPREAD_BYTES else df
