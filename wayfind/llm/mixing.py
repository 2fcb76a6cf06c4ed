"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents are shuffled by a hash, and a document's virtual
finish time is the flow's tokens up to and with it, divided by the flow's target; a source
whose target exceeds its size comes round again, up to ``MAX_REPEATS`` times. Documents
are taken in order of finish time until the budget is spent, so at any point every source
has had about its share, and no flow starves another.

Both running sums are made without ever sorting a whole source, or the whole corpus, in
one task: rows are ranged into buckets that hold about ``BUCKET_ROWS`` rows whatever the
input's size, bucket totals are pre-aggregated and summed in order, and only within one
bucket are rows sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.storage import materialize

MAX_REPEATS = 3
BUCKET_ROWS = 1_000
CUT_BUCKETS = 4_096
WORD = r"[^\x20\x09-\x0D]+"
#: Hash values of the shuffle are ranged by their first seven hexadecimal digits.
_HASH_SPACE = 16**7


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), null source allowed.

    Sources in order of code points, null last, take the weights in turn. The total of all
    sizes is shared by weight; no target exceeds ``most`` times its source, and what is over
    is shared again by weight. In order of most * size / weight the capped sources come
    first; the level of what is left falls once an uncapped one is taken off, so the highest
    level that its own source bears is where capping ends.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    given = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    cap = most * F.col("source_size").cast("double")
    rank = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        given.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("settled", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("settled"), F.col("cap")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _running(rows: DataFrame, group: list[str], bucket: str, order: list, size: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``size`` up to and with each row of its group, in ``order``.

    ``bucket`` must grow with the order. Bucket totals are few; rows meet only their bucket.
    """
    totals = rows.groupBy(*group, bucket).agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")))
    names = [f"_{c}" for c in [*group, bucket]]
    offsets = offsets.select(*(F.col(c).alias(n) for c, n in zip([*group, bucket], names, strict=True)), "_before")
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip([*group, bucket], names, strict=True)]
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_within", F.sum(size).over(within)).join(offsets, on, "inner")
    return placed.withColumn(into, F.col("_before") + F.col("_within")).drop("_within", "_before", *names)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: what the mix takes of it.

    (doc_id, size, source, source_size, target, copies, taken, first_finish): ``copies`` is how
    often the mix holds the document, ``taken`` its words in all copies, ``first_finish`` the
    virtual time of its first copy. Rows are range-sorted in the order of the queue, documents
    beyond the budget last. As documents are whole, a source's taken words differ from its
    target by less than its largest document and its share of the budget's rest. A null text and a
    text without words have size 0 and are never taken; null is a source of its own. Repeated
    rows are documents of their own. The order depends on ids, sizes and ``seed`` alone, so
    reruns agree. An empty table gives no rows.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("place"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes.select("source", "source_size"))
    counted = targets.withColumnRenamed("source", "_s").join(sizes.select(F.col("source").alias("_t"), "n"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    counted = materialize(counted, "targets", compact=True)
    buckets = F.greatest(F.lit(1).cast("long"), F.expr(f"n div {BUCKET_ROWS}"))
    flow = rows.join(counted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    range_of = (F.conv(F.substring("place", 1, 7), 16, 10).cast("long") * buckets / _HASH_SPACE).cast("long")
    flow = _running(flow.withColumn("bucket", range_of), ["source"], "bucket", ["place", "doc_id", "size"], "size", "tokens")
    flow = materialize(flow.drop("bucket", "place", "n"), "flow", compact=True)

    budget = flow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    finish = lambda k: (F.lit(k) * F.col("source_size") + F.col("tokens")) / F.col("target")
    queue = flow.where("size > 0 and target > 0").select("source", "doc_id", "size", F.explode(F.array(*(finish(k) for k in range(MAX_REPEATS)))).alias("finish"))
    cut = _cut(queue, budget)
    copies = sum((F.when(finish(k) <= F.lit(cut), 1).otherwise(0) for k in range(MAX_REPEATS)), F.lit(0))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(F.lit(0))
    decided = flow.select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
        F.when(copies > 0, finish(0)).alias("first_finish"),
    )
    return decided.orderBy(F.col("first_finish").asc_nulls_last(), "source", "doc_id")


def _cut(queue: DataFrame, budget: int) -> float:
    """The last finish time at which the sizes of all copies up to then are within the budget.

    Times are ranged into ``CUT_BUCKETS`` up to 2; the bucket in which the budget runs out is
    ranged again until few rows share one, and there the rows are summed in order. Copies of
    one finish time are taken together or not at all. Flows are spent at time 1, where the
    sum is the budget at most, so the cut is at 1 or after.
    """
    low, high, spent = 0.0, 2.0, 0
    inside = queue.where(F.col("finish") < high)
    for _ in range(6):
        width = (high - low) / CUT_BUCKETS
        ranged = inside.withColumn("b", F.floor((F.col("finish") - low) / width))
        sums = ranged.groupBy("b").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"), F.min("finish").alias("first"), F.max("finish").alias("last"))
        before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("run", F.sum("s").over(before) + F.lit(spent)).where(F.col("run") > budget).orderBy("b").first()
        if over is None:
            return high
        spent = over["run"] - over["s"]
        inside = inside.where((F.col("finish") >= over["first"]) & (F.col("finish") <= over["last"]))
        low, high = over["first"], over["last"]
        if over["c"] <= BUCKET_ROWS or low == high:
            break
    rows = inside.groupBy("finish").agg(F.sum("size").alias("s"))
    upto = Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("run", F.sum("s").over(upto) + F.lit(spent)).where(F.col("run") <= budget).agg(F.max("finish")).first()[0]
    return kept if kept is not None else math.nextafter(low, -math.inf)
