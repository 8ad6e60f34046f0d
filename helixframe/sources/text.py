"""Text formats: FASTA, BED and narrowPeak, labels, scores. Paths are read and written by
Spark, so any file system it knows will do; gzip'd files are recognised by their suffix."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import one_hot_decode
from ..plans.prefix import numbered


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole (model) file, unpacked if it is gzip'd whatever its name."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return gzip.decompress(bytes(data)) if bytes(data[:2]) == b"\x1f\x8b" else bytes(data)


def gzipped(spark: SparkSession, path: str) -> bool:
    """By the first two bytes, whatever the name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(where).isDirectory():
        return False
    stream = system.open(where)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (a line of a file, or of a folder's files, trimmed) and its place: block, mono. Spark unpacks by suffix;
    a gzip'd file of another name is unpacked on the driver."""
    if gzipped(spark, path) and not path.endswith(".gz"):
        lines = read_bytes(spark, path).decode().splitlines()
        return spark.createDataFrame([(0, i, x.strip()) for i, x in enumerate(lines)], "block long, mono long, value string")
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono"))
    return raw.select("block", "mono", F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A (model) file, on any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for at in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        stream.close()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (place in the file, from 0), name (the header line), seq. Records are split where a
    line starts with '>'; what stands before the first is dropped."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono"))
    first = rows.filter("block = 0").groupBy("file").agg(F.min("mono").alias("mono"), F.lit(True).alias("first"))
    rows = rows.join(first, ["file", "mono"], "left")
    begins = F.col("value").startswith(">")
    rows = rows.filter(F.col("first").isNull() | begins).withColumn("value", F.when(F.col("first") & begins, F.substring(F.col("value"), F.lit(2), F.length("value"))).otherwise(F.col("value")))
    rows = rows.select("file", "block", "mono", F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))
    return numbered(rows, ["file", "block"], ["mono"]).select("id", "name", "seq")


def write_fasta(seqs: DataFrame, path: str, line_width: int = 80) -> None:
    """name and seq as records; 0 leaves sequences on one line."""
    text = F.col("seq") if not line_width else F.regexp_replace("seq", f"(.{{{line_width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), text).alias("value")).write.text(path)


def write_fasta_one_hot(rows: DataFrame, path: str) -> None:
    """id and one_hot, as records seq_<id> on one line each."""
    write_fasta(rows.select(F.concat(F.lit("seq_"), F.col("id").cast("string")).alias("name"), one_hot_decode(F.col("one_hot")).alias("seq")), path, 0)


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, summit."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(\s*$|#|track|browser)"))
    c = F.split("value", "\t")
    item = lambda i: F.get(c, i)
    start, end = item(1).cast("long"), item(2).cast("long")
    peak = F.coalesce(item(9).try_cast("long"), F.lit(-1))
    named = F.when(F.coalesce(item(3), F.lit("")).isin("", "."), F.concat(item(0), F.lit(":"), item(1), F.lit("-"), item(2))).otherwise(item(3))
    return lines.select(item(0).alias("chrom"), start.alias("start"), end.alias("end"), named.alias("name"), F.when(peak >= 0, start + peak).otherwise(F.floor((start + end) / 2)).alias("summit"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id (line, from 0), y."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono")).filter("v <> ''")
    return numbered(lines, ["file", "block"], ["mono"]).select("id", F.col("v").cast("double").alias("y"))


def write_scores(scores: DataFrame, path: str) -> None:
    """name and score, tab-separated, six decimals."""
    scores.select("name", F.format_string("%.6f", "score").alias("score")).write.option("sep", "\t").option("header", True).csv(path)


def write_table(rows: DataFrame, path: str, notes: dict[str, str]) -> None:
    """A result table under lines of provenance, as `# name: value`, in one file."""
    head = "".join(f"# {name}: {value}\n" for name, value in notes.items()) + "\t".join(rows.columns) + "\n"
    cells = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns])
    lines = rows.sparkSession.createDataFrame([(head.removesuffix("\n"),)], "value string").union(rows.select(cells.alias("value")))
    lines.coalesce(1).write.text(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """name, value of the lines of provenance."""
    lines = spark.read.text(path).filter(F.col("value").startswith("#"))
    parts = F.split(F.regexp_replace("value", r"^#\s*", ""), r":\s*", 2)
    return lines.select(parts[0].alias("name"), F.get(parts, F.lit(1)).alias("value"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Result tables with lines of provenance that start with '#'."""
    return spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("inferSchema", True).csv(path)
