"""Card events as a stream into the event table, an extension: what reads the table sees each finished batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skeinwork.model import EVENTS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Patches from JSON files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).json(path)


def append_events(events: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends patches to the event table; the file sink's log keeps a batch that is run again from coming twice."""
    return events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
