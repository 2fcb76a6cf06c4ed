"""What fits: snippets under a token budget, and reports under a size.

A report's own choices depend on every earlier one and end in a handful of rows, so they are
made on the driver over rows that a top-k has already bounded. ``shrunk`` makes the same choice
as ``shrink`` where the rows are, by running sums.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as X
from wayfind.settings import COMPACT_PROJECTION
from wayfind.storage import materialize

MARK = "…"


def tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


def snippet_prefix(row: dict) -> str:
    """What stands before a snippet's context and counts for its cost."""
    at = row["location"]
    scope = "::".join(row["scope"] or []) or "root"
    span = f"{at['start']['line']}:{at['start']['column']}-{at['end']['line']}:{at['end']['column']}"
    return f"{row['path']} {row['kind']} {row['name']} {span} {scope}"


def fit(row: dict, budget: int) -> tuple[str, int, bool] | None:
    """(context, cost, truncated) of a snippet within a budget, or None."""
    prefix, context = snippet_prefix(row), row["context"] or ""
    cost = tokens(f"{prefix} {context}")
    if cost <= budget:
        return context, cost, False
    room = 4 * budget - len(prefix) - 1 - len(MARK)
    if budget <= 0 or room < 0:
        return None
    short = context[:room] + MARK
    return short, tokens(f"{prefix} {short}"), True


def select_snippets(scored: DataFrame, budget: int) -> dict[str, object]:
    """Snippets by score, path, place and name; one that does not fit even cut is passed over.

    A snippet costs one token at least, so no more than ``budget`` are ever taken, and any
    prefix is long enough to cost several; the rows come to the driver in order, as an
    iterator that stops once the budget is full.
    """
    order = [F.col("score").desc(), F.col("path"), *(F.col(f"location.{e}.{x}") for e in ("start", "end") for x in ("line", "column")), F.col("name")]
    chosen, used = [], 0
    for r in scored.orderBy(*order).toLocalIterator():
        row = r.asDict(recursive=True)
        made = fit(row, budget - used)
        if made is None:
            continue
        context, cost, cut = made
        used += cost
        chosen.append({**{k: row[k] for k in ("path", "language", "name", "kind", "score", "location")}, "context": context, "estimated_tokens": cost, "truncated": cut})
        if used >= budget:
            break
    return {"token_budget": budget, "estimated_tokens": used, "snippets": chosen}


#: In this order a payload gives up rows until it fits.
SHRINK_ORDER = ("findings", "snippets", "edges", "ranking", "files", "omissions")


def payload_tokens(report: dict) -> int:
    """Tokens of every text in a report's collections."""

    def walk(x: object) -> int:
        if isinstance(x, dict):
            return sum(map(walk, x.values()))
        if isinstance(x, list | tuple):
            return sum(map(walk, x))
        return 0 if x is None else tokens(str(x))

    return sum(walk(report.get(k, [])) for k in SHRINK_ORDER)


def text_tokens(rows: DataFrame, columns: list[str]) -> Column:
    """Tokens of a row's texts; a null is none."""
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), X.token_estimate(F.col(c).cast("string"))).otherwise(F.lit(0).cast("long")) for c in columns))


def running_sums(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each in a total order, over sorted partitions and their totals."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)), "running")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    sums = dealt.groupBy(F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, F.col("_part") == F.col("_p"))
    return out.select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))


def shrunk(payload: DataFrame, budget: int) -> DataFrame:
    """``payload`` (collection, place, tokens, ...) without the rows that ``shrink`` drops, for payloads of any size.

    Rows go from the last of the first collection of ``SHRINK_ORDER`` on, so those stay that are
    within the budget in the opposite order. ``place`` orders a collection's rows. Collections that
    are not in the order stay whole and count nothing.
    """
    rank = F.array_position(F.array(*map(F.lit, reversed(SHRINK_ORDER))), F.col("collection"))
    known = payload.withColumn("_rank", rank)
    kept = running_sums(known.where("_rank > 0"), ["_rank", "place"], "tokens", "_upto").where(F.col("_upto") <= budget)
    return kept.select(*payload.columns).unionByName(known.where("_rank = 0 or _rank is null").select(*payload.columns))


def shrink(report: dict[str, list], budget: int) -> dict[str, list]:
    """Drop last rows, collection by collection, until the payload is within the budget."""
    out = {k: list(v) for k, v in report.items()}
    for name in SHRINK_ORDER:
        while out.get(name) and payload_tokens(out) > budget:
            out[name].pop()
    return out


def halve(report: dict[str, list], max_bytes: int) -> dict[str, list]:
    """Halve the largest collection until the report as JSON is within a size."""
    out = {k: list(v) for k, v in report.items()}
    size = lambda v: len(json.dumps(v, default=str).encode())
    while size(out) > max_bytes and any(out.values()):
        largest = max(sorted(out), key=lambda k: size(out[k]))
        out[largest] = out[largest][: len(out[largest]) // 2]
    return out


def project(frames: dict[str, DataFrame], profile: str, orders: dict[str, list]) -> dict[str, DataFrame]:
    """Each collection in its order, up to what the profile shows."""
    out = {}
    for name, df in frames.items():
        rows = df.orderBy(*orders[name]) if name in orders else df
        most = COMPACT_PROJECTION.get(name) if profile == "compact" else None
        out[name] = rows.limit(most) if most is not None else rows
    return out
