"""Incremental ingest: a file stream upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.sources.table import SnapshotTable


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(source: DataFrame, table: SnapshotTable, checkpoint: str, order: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Upserts every micro-batch into ``table``; the checkpoint takes the place of a write-ahead log.

    A batch that is replayed after a failure upserts the same rows again, which changes nothing.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, order)

    writer = source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type in tumbling windows of event time, with a watermark. An extension for streams of events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
