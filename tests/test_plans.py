"""Intermediate tables, broadcasts by size, prefix sums."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from helixframe.plans import prefix, shared


def test_scratch_deletes_what_it_wrote(spark):
    kept = shared.materialize(spark.range(3), "kept")
    with shared.scratch(spark):
        gone = shared.materialize(spark.range(5), "gone")
        assert gone.count() == 5
        path = gone.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(cluster)


def test_broadcasts_go_by_bytes(spark):
    broadcast = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert broadcast(shared.sized(rows)) and broadcast(shared.sized(rows.limit(0)))
    assert not broadcast(shared.sized(rows, 90_000)) and not broadcast(shared.sized(rows, 1_000))


def test_running_sums_and_numbers(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i % 3, i) for i in range(101)], "a int, g int, v long")
    got = prefix.running(rows, ["a"], "v").collect()
    by_a = sorted((r.a, r.v) for r in got)
    assert {r.a: r.sum_v for r in got} == {a: sum(v for _, v in by_a[: i + 1]) for i, (a, _) in enumerate(by_a)}
    ids = prefix.numbered(rows, ["g"], ["a"]).orderBy("g", "a").collect()
    assert [r.id for r in ids] == list(range(101))
    assert prefix.running(rows.limit(0), "a", "v").count() == 0
