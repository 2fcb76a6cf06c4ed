"""Streaming queries, run to their end over a table (beyond the reference's own operators)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.session import table
from wayfind.storage import scratch_path
from wayfind.streaming.activity import windowed_activity


@register("stream_activity", "select date_trunc('day', ts)::timestamp as day, event_type, count(*)::bigint as n from events group by all")
def stream_activity(spark, d):
    """Daily activity by kind from a stream over the events' file, drained by one trigger."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = windowed_activity(stream, window="1 day", late="3650 days", keys=("event_type",))
    name = f"activity_{uuid.uuid4().hex}"
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")
