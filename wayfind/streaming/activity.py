"""Activity and keyword signals over a stream of commits or events.

An extension beyond the batch engine: the same predicates, with event-time windows and a
watermark, so that late rows count until it passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import matched_keywords


def windowed_activity(events: DataFrame, time_col: str = "ts", window: str = "1 day", late: str = "2 days", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, *keys, n): events by tumbling window, for streams and for batches."""
    stamped = events.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def keyword_alerts(commits: DataFrame, keywords: tuple[str, ...], substring: bool = False) -> DataFrame:
    """Commits whose message holds a keyword, with the terms; stateless, so append mode."""
    return commits.withColumn("matched_terms", matched_keywords(F.col("message"), keywords, substring)).where(F.size("matched_terms") > 0)
