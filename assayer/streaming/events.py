"""Event streams: read the appended JSON lines, mask secrets, write on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import EVENT_SCHEMA, redact_events


def read_event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, **options) -> DataFrame:
    """Follow a folder of event files; ``run_id`` folders become a column."""
    return spark.readStream.schema(schema).options(**options).json(path)


def write_redacted_events(
    events: DataFrame, columns, path: str, checkpoint: str, *, trigger: dict | None = None
) -> StreamingQuery:
    """The batch projection on a stream; the sink's checkpoint makes restarts exact."""
    return (
        redact_events(events, columns)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
