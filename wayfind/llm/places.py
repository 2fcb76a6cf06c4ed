"""The place of every row in its group, however large the group.

Rows are dealt out by ranges of (group, order), so a group with a third of all rows is spread
over a third of the partitions. Their ids of increasing order within a partition are written
down; the rows that each partition has of a group are then summed over the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.storage import materialize


def placed(df: DataFrame, group: Sequence[str], order: Sequence[str], place: str = "place", size: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``place``, from 0 on, by ``order`` within ``group``, and the group's ``size``.

    Nulls come first, and make a group of their own. Of equal rows either may be first. An empty
    table gives no rows. The result is read from a table in the shared folder. ``df`` must have
    no column that begins with ``_at``.
    """
    keys = [*group, *order]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_at_part", F.shiftright("_at", 33)), "places")
    held = rows.groupBy("_at_part", *group).agg(F.min("_at").alias("_at_first"), F.count(F.lit(1)).alias("_at_n"))
    before = Window.partitionBy(*group).orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_at_before", F.coalesce(F.sum("_at_n").over(before), F.lit(0)))
    if size:
        held = held.withColumn(size, F.sum("_at_n").over(Window.partitionBy(*group)))
    held = held.select(F.col("_at_part").alias("_at_p"), *(F.col(g).alias(f"_at_g{k}") for k, g in enumerate(group)), "_at_first", "_at_before", *([size] if size else []))
    same = F.col("_at_part") == F.col("_at_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_at_g{k}"))
    out = rows.join(held, same).withColumn(place, F.col("_at") - F.col("_at_first") + F.col("_at_before"))
    return out.select(*df.columns, place, *([size] if size else []))
