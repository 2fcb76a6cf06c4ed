"""Which paths a source map looks at, and why others are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import paths as P
from wayfind.functions import text as X
from wayfind.functions.labels import actionable_limitation
from wayfind.settings import MapSettings
from wayfind.storage import materialize

STATE_ORDER = ("modified", "untracked", "tracked", "unknown")


def modified_paths(index: DataFrame, worktree: DataFrame) -> DataFrame:
    """Index paths whose worktree file is missing or has other bytes (``content`` on both sides)."""
    here = worktree.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("_now"))
    there = index.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("_then"))
    return there.join(here, "path", "left").where(~F.col("_then").eqNullSafe(F.col("_now"))).select("path")


def candidates(tracked: DataFrame, modified: DataFrame, visible: DataFrame, submodules: DataFrame | None = None) -> DataFrame:
    """(path, state, symlink): tracked and visible paths; a tracked state wins, symlink flags are ORed."""
    if submodules is not None:
        tracked = tracked.join(submodules.select("path"), "path", "left_anti")
    changed = modified.select("path").distinct().withColumn("changed", F.lit(True))
    known = tracked.select("path", F.coalesce("symlink", F.lit(False)).alias("s")).groupBy("path").agg(F.bool_or("s").alias("s"))
    known = known.join(changed, "path", "left").select("path", F.when(F.col("changed"), "modified").otherwise("tracked").alias("own"), "s")
    seen = visible.groupBy("path").agg(F.bool_or(F.coalesce("symlink", F.lit(False))).alias("w"))
    both = known.join(seen, "path", "full_outer")
    return both.select("path", F.coalesce("own", F.lit("untracked")).alias("state"), (F.coalesce("s", F.lit(False)) | F.coalesce("w", F.lit(False))).alias("symlink"))


def ignored_paths(everything: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of the unrestricted walk that are neither candidates nor classified."""
    left = everything.select("path").distinct().join(known.select("path"), "path", "left_anti")
    return left.where(F.size(P.classify(F.col("path"))) == 0)


def inventory(found: DataFrame) -> DataFrame:
    """(tracked, modified, untracked) counts; modified paths are tracked too."""
    return found.agg(
        F.count_if(F.col("state").isin("tracked", "modified")).alias("tracked"),
        F.count_if(F.col("state") == "modified").alias("modified"),
        F.count_if(F.col("state") == "untracked").alias("untracked"),
    )


def cache_requests(requested: DataFrame, eligible: DataFrame) -> DataFrame:
    """(path, matched) for each file that the caller named for the cache."""
    known = eligible.select("path").distinct().withColumn("matched", F.lit(True))
    return requested.select("path").distinct().join(known, "path", "left").select("path", F.coalesce("matched", F.lit(False)).alias("matched"))


def omission_reason(settings: MapSettings) -> Column:
    """The first gate that a candidate fails, or null, over path, state, symlink and content.

    The order is the semantics: exclusion, symlink, path class, language, read, size, binary
    or no UTF-8, shebang, content class. A focus path lifts classification.
    """
    path, content = F.col("path"), F.col("content").cast("string")
    focused = P.focus_includes(path, settings.focus_paths)
    lua_place = path.rlike(r"(^|/)(bin|scripts)/[^/.]+$")
    lang = P.language(path)
    size = F.octet_length("content")
    minified = X.minified(P.extension(path), content)
    return (
        F.when(P.excluded(path, settings.excludes), "explicit_exclusion")
        .when(P.safety_kind(path).isNotNull(), "unsafe_path")
        .when(F.col("symlink"), "symlink")
        .when((F.size(P.classify(path)) > 0) & ~focused, "classified")
        .when(lang.isNull() & ~lua_place, F.when(P.source_like(path), "unsupported_language").otherwise("non_source"))
        .when(F.col("content").isNull(), "read_error")
        .when(size > settings.limits.file_bytes, "oversized")
        .when(X.binary(F.col("content").cast("binary")), "binary")
        .when(lang.isNull() & ~P.lua_entry(path, F.split_part(content, F.lit("\n"), F.lit(1))), "non_source")
        .when((X.generated_marker(content) | minified) & ~focused, "classified")
    )


def gated(found: DataFrame, settings: MapSettings) -> DataFrame:
    """Candidates with language and omission_reason (null: to be parsed)."""
    lang = F.coalesce(P.language(F.col("path")), F.when(P.lua_entry(F.col("path"), F.split_part(F.col("content").cast("string"), F.lit("\n"), F.lit(1))), "lua"))
    return found.withColumns({"omission_reason": omission_reason(settings), "language": lang})


def greedy_within(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """``rows`` with ``kept``: in each group, in order, each is taken if it still fits, else passed over.

    A choice depends on all before it, so the rows of a group meet in one fold: for many small
    groups. ``greedy_rounds`` does the same for large ones.
    """
    held = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, size))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r[size] <= budget
        return F.struct(F.when(fits, acc["used"] + r[size]).otherwise(acc["used"]).alias("used"), F.concat(acc["out"], F.array(fits)).alias("out"))

    kept = F.aggregate("rows", start, step, lambda acc: acc["out"])
    zipped = held.withColumn("kept", kept).select(*group, F.explode(F.arrays_zip("rows", "kept")).alias("z"))
    return zipped.select(*group, *(F.col(f"z.rows.{c}").alias(c) for c in [*order, size]), F.col("z.kept").alias("kept"))


def greedy_rounds(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """As ``greedy_within``, for groups of any size: rounds of running sums instead of a fold.

    In a round all rows before the first that does not fit are taken, that one is passed over, and
    of the rows after it those stay that are no larger than what is left. Rounds are as many as
    the rows passed over for want of a little, few where sizes vary. Running sums go over sorted
    partitions first and over the partitions' totals then, so that no task has a whole group.
    A null size never fits; a negative one is refused.
    """
    keys = [*group, *order, size]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    table = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)), "greedy")
    if table.where(F.col(size) < 0).limit(1).count():
        raise ValueError(f"{size} must not be negative")
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    named = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    fits = reduce(lambda a, b: a & b, same, F.lit(True))
    left = materialize(table.select(*group).distinct().select(*named, F.lit(budget).cast("long").alias("_left")), "left", compact=True)
    rest, taken = table.where(F.col(size) <= budget).select(*group, size, "_at", "_part"), []
    rest = materialize(rest, "rest")
    while rest.limit(1).count():
        sums = rest.groupBy("_part", *group).agg(F.sum(size).alias("_sum"))
        before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("_part").alias("_p"), *named, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
        within = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        run = rest.withColumn("_run", F.sum(size).over(within)).join(sums, (F.col("_part") == F.col("_p")) & fits).drop("_p", *(f"_g{k}" for k in range(len(group))))
        run = run.withColumn("_run", F.col("_run") + F.col("_before")).drop("_before").join(F.broadcast(left) if not group else left, fits)
        run = materialize(run, "run")
        first = run.groupBy(*(f"_g{k}" for k in range(len(group)))).agg(F.min(F.when(F.col("_run") > F.col("_left"), F.col("_at"))).alias("_first"), F.max(F.when(F.col("_run") <= F.col("_left"), F.col("_run"))).alias("_used"), F.max("_left").alias("_had"))
        left = materialize(first.select(*(f"_g{k}" for k in range(len(group))), (F.col("_had") - F.coalesce("_used", F.lit(0))).alias("_left"), "_first"), "left", compact=True)
        took = run.where("_run <= _left").select("_at")
        taken.append(took)
        later = run.select(*group, size, "_at", "_part").join(left, fits).where((F.col("_at") > F.col("_first")) & (F.col(size) <= F.col("_left")))
        rest = materialize(later.select(*group, size, "_at", "_part"), "rest")
        left = left.drop("_first")
    every = table.select("_at").limit(0)
    for more in taken:
        every = every.unionAll(more)
    marked = table.join(every.select(F.col("_at").alias("_taken")), F.col("_at") == F.col("_taken"), "left")
    return marked.select(*keys, F.col("_taken").isNotNull().alias("kept"))


def classification_summary(files: DataFrame) -> DataFrame:
    """(paths, generated, vendor, minified, source_map): a path may count under several kinds."""
    kinds = F.transform(P.classify(F.col("path")), lambda c: c["kind"])
    held = files.select("path", kinds.alias("kinds")).where(F.size("kinds") > 0).distinct()
    counts = [F.count_if(F.array_contains("kinds", k)).alias(k) for k in ("generated", "vendor", "minified", "source_map")]
    return held.agg(F.count(F.lit(1)).alias("paths"), *counts)


def collection_summary(total: int, returned: int, reason: str) -> dict[str, object]:
    """What a bounded collection says of itself."""
    cut = returned < total
    return {"total": total, "returned": returned, "truncated": cut, "reason": reason if cut else None}


def collection_rows(name: str, rows: DataFrame, most: int, reason: str = "collection_limit") -> DataFrame:
    """(name, total, returned, truncated, reason) of a collection of which ``most`` rows are shown, counted where it is."""
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total")).select(
        F.lit(name).alias("name"), "total", F.least("total", F.lit(most).cast("long")).alias("returned"), (F.col("total") > most).alias("truncated"), F.when(F.col("total") > most, reason).alias("reason")
    )


def availability_row(files: DataFrame, omissions: DataFrame) -> DataFrame:
    """One row of counts and names of what a map could not show in full.

    ``files`` has path, status and limitations; ``omissions`` path and reason; nulls count nowhere.
    Lists are distinct, in order of path, as long as a map's ceilings let them be.
    """
    names = lambda where: F.array_sort(F.collect_set(F.when(where, F.col("path"))))
    reason = F.col("reason")
    left_out = omissions.agg(
        names(reason == "unsupported_language").alias("unsupported_path_names"), names(reason == "cache_unavailable").alias("cache_unavailable_path_names"),
        F.count_if(reason.isin("unsafe_path", "symlink")).alias("unsafe_paths"), F.coalesce(F.bool_or(reason.isin("traversal_error", "oversized")), F.lit(False)).alias("_over"),
    )
    shown = files.agg(names(F.col("status") == "partial").alias("partial_path_names"), F.coalesce(F.bool_or(F.exists("limitations", actionable_limitation)), F.lit(False)).alias("_limited"))
    both = left_out.crossJoin(shown)  # one row and one row
    sizes = {"unsupported_paths": "unsupported_path_names", "partial_files": "partial_path_names", "cache_unavailable_paths": "cache_unavailable_path_names"}
    return both.select(*(F.size(c).cast("long").alias(n) for n, c in sizes.items()), (F.col("_over") | F.col("_limited")).alias("resource_limited"), "unsafe_paths", *sizes.values())


def availability(files: DataFrame, omissions: DataFrame) -> dict[str, object]:
    """``availability_row`` for a report."""
    return availability_row(files, omissions).first().asDict()
