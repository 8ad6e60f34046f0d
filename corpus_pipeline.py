"""The corpus pipeline: toxicity, exact dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents; all but the last keep the documents' columns,
whatever their names. A stage's intermediate tables are deleted once its result is written,
and its input once the next stage's is.

Defined results: a null text counts as empty, isn't toxic, and of empty texts exact dedup
keeps one, that with the largest doc_id (a null one is the smallest); of equal rows one
stays; ties are resolved as the operators say; a null source is a source; very long texts go
through whole; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from helixframe.llm.common import drop, scratch, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Banding, the ordinal model and the packing programme have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if i:
            drop(spark, f"{top}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
