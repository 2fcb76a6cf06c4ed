"""The parse cache as a table: lookup, retention and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RECORDS, MAX_BYTES, MAX_AGE_DAYS = 256, 32 << 20, 30
KEY = ["repository_id", "path", "language", "query_digest"]
RECORDS = "repository_id string, path string, language string, query_digest string, fingerprint string, created_at timestamp, bytes bigint, payload string"


def fingerprint(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def lookup(files: DataFrame, cache: DataFrame, mode: str = "auto") -> DataFrame:
    """``files`` (key columns and fingerprint) with cache_status and the record's ``payload``.

    A record with the same fingerprint is a hit. In manual mode the newest record of the key
    serves too, as stale. always and no_cache never hit.
    """
    if mode in ("always", "no_cache"):
        return files.withColumns({"cache_status": F.lit("refreshed" if mode == "always" else "disabled"), "payload": F.lit(None).cast("string")})
    exact = cache.groupBy(*KEY, "fingerprint").agg(F.max_by("payload", "created_at").alias("exact"))
    joined = files.join(exact, [*KEY, "fingerprint"], "left")
    if mode != "manual":
        return joined.select(*files.columns, F.when(F.col("exact").isNotNull(), "hit").otherwise("refreshed").alias("cache_status"), F.col("exact").alias("payload"))
    newest = cache.groupBy(*KEY).agg(F.max_by("payload", "created_at").alias("newest"))
    both = joined.join(newest, KEY, "left")
    status = F.when(F.col("exact").isNotNull(), "hit").when(F.col("newest").isNotNull(), "stale").otherwise("miss")
    return both.select(*files.columns, status.alias("cache_status"), F.coalesce("exact", "newest").alias("payload"))


def records_of(parsed: DataFrame, now: Column) -> DataFrame:
    """Records to keep from rows with the key columns, fingerprint and payload."""
    return parsed.select(*KEY, "fingerprint", now.cast("timestamp").alias("created_at"), F.octet_length("payload").cast("long").alias("bytes"), "payload")


def stats(looked: DataFrame) -> DataFrame:
    """One row: hits (stale ones too), misses, refreshed, stale and unavailable files of a run.

    ``looked`` has cache_status: hit, stale, refreshed (parsed now), forced (parsed whatever the
    cache holds), disabled or unavailable.
    """
    n = lambda *kinds: F.count_if(F.col("cache_status").isin(*kinds))
    return looked.agg(
        n("hit", "stale").alias("hits"), n("refreshed", "unavailable").alias("misses"), n("refreshed", "forced").alias("refreshed"), n("stale").alias("stale"), n("unavailable").alias("unavailable")
    )


def plan(files: DataFrame, records: DataFrame, mode: str, requested: DataFrame | None = None) -> DataFrame:
    """``files`` with cache_status and the payload to use; a null payload is to be parsed, unless unavailable.

    auto parses what has no record of its content. always parses all, files the ``requested``
    (path), and manual none; what is then without a record is unavailable, and manual serves
    stale records. no_cache looks nothing up.
    """
    if mode in ("always", "no_cache"):
        return files.withColumns({"cache_status": F.lit("forced" if mode == "always" else "disabled"), "payload": F.lit(None).cast("string")})
    found = lookup(files, records, "manual" if mode == "manual" else "auto")
    missing = F.col("payload").isNull()
    if mode == "auto":
        return found
    if mode == "manual":
        return found.withColumn("cache_status", F.when(missing, "unavailable").otherwise(F.col("cache_status")))
    asked = requested.select("path").distinct().withColumn("_asked", F.lit(True))
    both = found.join(asked, "path", "left")
    status = F.when(F.col("_asked"), "forced").when(missing, "unavailable").otherwise(F.col("cache_status"))
    return both.select(*files.columns, status.alias("cache_status"), F.when(F.col("_asked"), None).otherwise(F.col("payload")).alias("payload"))


def retained(records: DataFrame, now: Column, max_records: int = MAX_RECORDS, max_bytes: int = MAX_BYTES, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Records younger than the age, the newest of each repository up to both ceilings.

    A repository holds few records between two prunings, so its window is small. Of equal
    times the smaller path is kept first.
    """
    order = Window.partitionBy("repository_id").orderBy(F.col("created_at").desc(), "path")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    young = records.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(max_age_days)))
    placed = young.withColumns({"_place": F.row_number().over(order), "_sum": F.sum("bytes").over(running)})
    return placed.where((F.col("_place") <= max_records) & (F.col("_sum") <= max_bytes)).drop("_place", "_sum")


def totals(records: DataFrame) -> DataFrame:
    """(repository_id, records, bytes)."""
    return records.groupBy("repository_id").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))


def overall_status(mode: str, hits: int, refreshed: int, stale: int) -> str:
    """One status for a run: disabled, stale, refreshed or hit, the first that applies, else miss."""
    if mode == "no_cache":
        return "disabled"
    return "stale" if stale else "refreshed" if refreshed else "hit" if hits else "miss"
