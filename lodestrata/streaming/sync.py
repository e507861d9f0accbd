"""Streams of sync items and jobs into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import upserted, without
from .tables import VersionedTable, stream_name


def jobs_once(jobs: DataFrame, delay: str | None = None) -> DataFrame:
    """One job for each connection and item: of a table the first by seq, of a stream the first within the delay."""
    keys = ["connection_id", "external_id"]
    if jobs.isStreaming:
        return jobs.withWatermark("ts", delay or "1 hour").dropDuplicatesWithinWatermark(keys)
    return jobs.groupBy(*keys).agg(F.min_by(F.struct(*jobs.columns), "seq").alias("j")).select("j.*")


def merged_batch(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources after a batch of items (action created, updated or deleted): the last item of each key counts."""
    last = batch.groupBy("connection_id", "external_id").agg(F.max_by(F.struct(*batch.columns), "seq").alias("i")).select("i.*")
    kept = without(existing.withColumn("k", F.concat_ws("\u0001", "connection_id", "external_id")), last.where("action = 'deleted'").select(F.concat_ws("\u0001", "connection_id", "external_id").alias("k")), "k").drop("k")
    return upserted(kept, last.where("action <> 'deleted'").drop("action"))


def sync_stream(items: DataFrame, table: VersionedTable, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = merged_batch, every: str | None = None) -> StreamingQuery:
    """Merge a stream of items into a table; all that is there now, or every so often if every is given.

    The table remembers the last batch of each checkpoint: a replayed batch changes nothing, and streams with checkpoints of
    their own, one after another or at once, all get their rows in.
    """
    name = stream_name(items.sparkSession, checkpoint)
    writer = items.writeStream.foreachBatch(lambda batch, number: table.merge(batch, merge, name(), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def strictly_increasing(messages: DataFrame, key: str = "writer_id") -> DataFrame:
    """Messages of each writer with times that never repeat: a message is at least a millisecond after the one before it.

    The k-th message is as late as the latest earlier one plus their distance, which is a running maximum.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("seq")
    n = F.row_number().over(w)
    x = messages.withColumn("n", n)
    up = F.max(F.col("millis") - F.col("n")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("millis", up + F.col("n")).drop("n")


def throttled_stream(requests: DataFrame, period: str = "60 seconds", most: int = 100, delay: str = "5 minutes") -> DataFrame:
    """Fixed windows of a stream of requests (key, ts) with how many were over the limit; late ones beyond delay are dropped."""
    g = requests.withWatermark("ts", delay).groupBy("key", F.window("ts", period)).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("key", F.col("window.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - most).alias("blocked"))
