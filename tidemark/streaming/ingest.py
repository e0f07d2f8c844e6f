"""Structured Streaming ingest into an index.

Every accepted row is kept, however late: no watermark. A batch is written once: its id names its folder, and a folder that
the manifest knows is not written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.datetimes import window_start
from ..sources.catalog import Index
from ..sources.formats import CORRUPT


def ingest(stream: DataFrame, index: Index, checkpoint: str, transforms: dict[str, str] | None = None, accept_since: str | None = None, once: bool = True, every: str = "60 seconds") -> StreamingQuery:
    """Start the ingest; corrupt lines go to ``quarantine/`` under the index, with a count of them in the metrics."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{index.data}/batch={batch_id:012d}"
        if index.exists() and index.spark.read.parquet(f"{index.path}/manifest").filter(F.col("file").contains(f"/batch={batch_id:012d}/")).limit(1).count():
            return
        good = batch
        if CORRUPT in batch.columns:
            batch.persist()
            batch.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT).write.mode("append").parquet(f"{index.path}/quarantine")
            good = batch.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
        for name, expression in (transforms or {}).items():
            good = good.withColumn(name, F.expr(expression))
        if accept_since and index.timestamp:
            good = good.filter(F.col(index.timestamp) >= F.expr(accept_since))
        index.remember(good)
        index.write(good, folder, "overwrite")
        index.publish(folder)
        if CORRUPT in batch.columns:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def with_window(df: DataFrame, seconds_column: str, duration: int = 900) -> DataFrame:
    """Each row's own window, for partitioning."""
    return df.withColumn("window_start", window_start(F.col(seconds_column), duration))


def windowed_counts(stream: DataFrame, timestamp: str, key: str, width: str, late: str) -> DataFrame:
    """An extension: event-time windows with a watermark."""
    return stream.withWatermark(timestamp, late).groupBy(F.window(timestamp, width), key).count()
