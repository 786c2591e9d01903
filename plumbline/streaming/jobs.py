"""Continuous scoring, appeals and queue counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.evalset import review_queue


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scores a stream by a plain projection: ``score`` shuffles nothing and needs no state.

    The sink's log commits each batch's files once, so a restart after a failure neither loses nor repeats rows. Records fall into folders by ``rejected``, so readers of
    either kind pass over the other.
    """
    writer = score(stream).withColumn("rejected", F.col("reject").isNotNull()).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("rejected")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def append_stream(appeals: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends appeals; malformed ones are gone by the reader's mode, each for itself."""
    writer = appeals.writeStream.outputMode("append").format("json").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def queue_stream(appeals: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Live counts by correction: one key per kind, kept in complete mode."""
    writer = review_queue(appeals, "correction", F.col("reviewed")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
