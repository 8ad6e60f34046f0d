"""Scoring of streams against a fixed model (an extension: the models themselves are batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def score_stream(model, stream: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Each micro-batch of seqs(id, seq) is scored as a table and handed to sink(scores, epoch).
    A sequence's score needs its own row only, so there is no state and no watermark."""

    def batch(rows: DataFrame, epoch: int) -> None:
        sink(model.score(rows), epoch)

    return stream.writeStream.foreachBatch(batch)
