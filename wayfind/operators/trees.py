"""Merkle trees of files as relations: built, walked and compared level by level.

A tree object is its entries (tree, name, mode, oid); equal trees have equal ids. Walks and
comparisons expand a frontier, one equi-join a level, for all roots at once; a subtree whose id
is the same on both sides is never opened. What a ceiling leaves out is counted by reason and
returned beside the result, so a caller can say that it is incomplete.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.storage import materialize

DIRECTORY, GITLINK = "040000", "160000"
MAX_CHANGED_PATHS, MAX_NODES, MAX_ENTRIES, MAX_DEPTH = 10_000, 100_000, 4_096, 2_048
#: Parts of a folder in which it is digested.
BUCKETS = 256

#: Gives the entries (tree, name, mode, oid) of a DataFrame of tree ids (tree).
Lookup = Callable[[DataFrame], DataFrame]
LOSSES = "id string, reason string, n long"


def stored(entries: DataFrame) -> Lookup:
    """Look trees up in a relation of entries."""
    return lambda wanted: entries.join(wanted, "tree", "left_semi")


def built(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, entries) of ``files`` (id, path, mode, oid): roots are (id, tree), entries those of all trees, each tree once.

    Bottom-up, a level of folders at a time. A folder's id is a digest of digests: of the sorted
    entries in each of ``BUCKETS`` parts by name, so that no row holds a whole large folder.
    """
    level = materialize(files.select("id", F.split("path", "/").alias("parts"), "mode", "oid"), "level")
    deepest = level.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    levels, folders = [], []
    for depth in range(deepest, 0, -1):
        here = F.size("parts") == depth
        entry = F.struct(F.element_at("parts", depth).alias("name"), "mode", "oid")
        named = level.where(here).select("id", F.slice("parts", 1, depth - 1).alias("parts"), entry.alias("e"))
        buckets = named.groupBy("id", "parts", F.pmod(F.xxhash64("e.name"), F.lit(BUCKETS)).alias("bucket")).agg(F.array_sort(F.array_agg("e")).alias("entries"))
        buckets = materialize(buckets.withColumn("digest", F.sha2(F.to_json("entries"), 256)), "buckets")
        said = F.array_sort(F.array_agg(F.struct("bucket", "digest")))
        grouped = materialize(buckets.groupBy("id", "parts").agg(F.sha2(F.to_json(said), 256).alias("tree")), "folders")
        levels.append((depth, buckets))
        folders.append(grouped.withColumn("depth", F.lit(depth)))
        above = level.where(~here).unionByName(grouped.select("id", "parts", F.lit(DIRECTORY).alias("mode"), F.col("tree").alias("oid")))
        level = above if depth == 1 else materialize(above, "level")
    if not levels:
        return level.select("id", F.col("oid").alias("tree")), files.select(F.lit("").alias("tree"), F.lit("").alias("name"), "mode", "oid").limit(0)
    one = reduce(DataFrame.unionByName, folders).groupBy("tree").agg(F.min(F.struct("depth", "id", "parts")).alias("at")).select("tree", "at.*")
    one = materialize(one, "one")
    made = [buckets.join(one.where(F.col("depth") == depth), ["id", "parts"]).select("tree", F.explode(F.array_distinct("entries")).alias("e")).select("tree", "e.*") for depth, buckets in levels]
    return level.select("id", F.col("oid").alias("tree")), materialize(reduce(DataFrame.unionByName, made), "entries")


def _ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def _within(rows: DataFrame, used: DataFrame, taken: str, most: int, reason: str, label: str) -> tuple[DataFrame, DataFrame | None]:
    """The first of ``rows`` of each id by path, up to ``most`` with those ``taken`` before; and losses, None if there are none.

    Only ids that go over are ranked: all rows of another need not meet in one task.
    """
    so_far = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(used.select("id", F.col(taken).alias("_taken")), "id")
    tight = materialize(so_far.where(F.col("n") + F.col("_taken") > most), "tight", compact=True)
    if not tight.limit(1).count():
        return rows, None
    ranked = _ranked(rows.join(tight, "id"), ["id"], ["path"]).where(F.col("_rank") <= most).where(F.col("_rank") + F.col("_taken") <= most)
    kept = materialize(rows.join(tight, "id", "left_anti").unionByName(ranked.select(*rows.columns)), label)
    shown = kept.groupBy("id").agg(F.count(F.lit(1)).alias("_kept"))
    return kept, tight.join(shown, "id", "left").select("id", F.lit(reason).alias("reason"), (F.col("n") - F.coalesce("_kept", F.lit(0))).alias("n"))


def _bounded(entries: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` entries (None: all) of each tree by name, one of each name; and (tree, n, doubled) of what that leaves out."""
    first = Window.partitionBy("tree", "name").orderBy("mode", "oid")
    rows = entries.select("tree", "name", "mode", "oid").withColumn("_copy", F.row_number().over(first))
    rows = rows.where("_copy = 1")
    doubled = entries.groupBy("tree", "name").count().where("count > 1").groupBy("tree").agg(F.sum(F.col("count") - 1).alias("doubled"))
    if most is None:
        return rows.drop("_copy"), doubled.select("tree", F.lit(None).cast("long").alias("n"), "doubled")
    rows = _ranked(rows, ["tree"], ["name"])
    cut = rows.where(F.col("_rank") > most).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("_rank") <= most).drop("_rank", "_copy"), cut.join(doubled, "tree", "full")


def _summed(losses: list[DataFrame], spark) -> DataFrame:
    out = spark.createDataFrame([], LOSSES)
    for more in losses:
        out = out.unionByName(more)
    return out.groupBy("id", "reason").agg(F.sum("n").alias("n")).where("n > 0")


def _noted(cut: DataFrame, reach: DataFrame) -> DataFrame:
    """Losses of trees, for each root that reaches them: ``reach`` is (id, tree)."""
    both = reach.join(cut, "tree")
    wide = both.where("n > 0").select("id", F.lit("entries").alias("reason"), "n")
    return wide.unionAll(both.where("doubled > 0").select("id", F.lit("collisions").alias("reason"), F.col("doubled").alias("n")))


def walk(roots: DataFrame, lookup: Lookup, prune: Callable | None = None, max_nodes: int = MAX_NODES, max_entries: int | None = MAX_ENTRIES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(id, path, mode, oid) of the files and links under ``roots`` (id, tree), and losses (id, reason, n).

    ``prune`` is a predicate on a folder's path: such folders are not opened, which is no loss. Each
    root opens at most ``max_nodes`` entries, level by level and by path, and ``max_entries`` of
    a folder (None: all); a name twice in a folder counts once. Folders at ``max_depth`` are not opened.
    Losses are counted: ``entries``, ``collisions``, ``nodes`` (entries that are not opened or
    shown, without what is below them), ``depth`` and ``missing`` (trees that the lookup does not have).
    """
    spark = roots.sparkSession
    frontier = materialize(roots.select("id", F.lit("").alias("at"), "tree"), "frontier", compact=True)
    used = roots.select("id", F.lit(0).cast("long").alias("used"))
    found, losses = [], []
    for depth in range(max_depth + 1):
        if not frontier.limit(1).count():
            break
        if depth == max_depth:
            losses.append(frontier.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit("depth").alias("reason"), "n"))
            break
        entries = materialize(lookup(frontier.select("tree").distinct()).select("tree", "name", "mode", "oid"), "entries")
        kept, cut = _bounded(entries, max_entries)
        losses.append(_noted(cut, frontier.select("id", "tree")))
        gone = frontier.join(entries.select("tree").distinct(), "tree", "left_anti")
        losses.append(gone.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit("missing").alias("reason"), "n"))
        rows = frontier.join(kept, "tree").select("id", F.concat("at", "name").alias("path"), "mode", "oid")
        if prune is not None:
            rows = rows.where((F.col("mode") != DIRECTORY) | ~prune(F.col("path")))
        shown, lost = _within(materialize(rows, "walked"), used, "used", max_nodes, "nodes", "shown")
        losses += [] if lost is None else [lost]
        used = materialize(used.join(shown.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", (F.col("used") + F.coalesce("n", F.lit(0))).alias("used")), "used", compact=True)
        found.append(shown.where(F.col("mode") != DIRECTORY).select("id", "path", "mode", "oid"))
        frontier = materialize(shown.where(F.col("mode") == DIRECTORY).select("id", F.concat("path", F.lit("/")).alias("at"), F.col("oid").alias("tree")), "frontier", compact=True)
    out = found[0] if found else roots.select("id", F.lit("").alias("path"), F.lit("").alias("mode"), F.lit("").alias("oid")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out, _summed(losses, spark)


def changed_paths(
    pairs: DataFrame, lookup: Lookup, max_paths: int = MAX_CHANGED_PATHS, max_nodes: int = MAX_NODES, max_entries: int | None = MAX_ENTRIES, max_depth: int = MAX_DEPTH
) -> tuple[DataFrame, DataFrame]:
    """(id, path, before, after) of the files that differ between two trees, and losses (id, reason, n).

    ``pairs`` has id, old and new; a null tree is empty. Both trees are gone down together: an
    entry with the same mode and object on both sides is left, and so is all below it. A file that
    becomes a folder is gone, and the folder's files are new. ``before`` and ``after`` are object
    ids, null where there is no file. Each id shows ``max_paths`` files, by path within a level, and
    compares ``max_nodes`` entries; losses are counted as by ``walk``, with ``paths`` for files.
    """
    spark = pairs.sparkSession
    frontier = materialize(pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("id", F.lit("").alias("at"), "old", "new"), "frontier", compact=True)
    used = pairs.select("id", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("shown"))
    found, losses = [], []
    for depth in range(max_depth + 1):
        if not frontier.limit(1).count():
            break
        if depth == max_depth:
            losses.append(frontier.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit("depth").alias("reason"), "n"))
            break
        reach = frontier.select("id", F.explode(F.array("old", "new")).alias("tree")).where("tree is not null")
        entries = materialize(lookup(reach.select("tree").distinct()).select("tree", "name", "mode", "oid"), "entries")
        kept, cut = _bounded(entries, max_entries)
        losses.append(_noted(cut, reach))
        gone = reach.join(entries.select("tree").distinct(), "tree", "left_anti")
        losses.append(gone.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit("missing").alias("reason"), "n"))
        side = lambda which: frontier.select("id", "at", F.col(which).alias("tree")).join(kept, "tree").select("id", F.concat("at", "name").alias("path"), F.col("mode").alias(f"{which}_mode"), F.col("oid").alias(f"{which}_oid"))
        rows = side("old").join(side("new"), ["id", "path"], "full").where("not (old_mode <=> new_mode and old_oid <=> new_oid)")
        rows, lost = _within(materialize(rows, "compared"), used, "used", max_nodes, "nodes", "kept")
        losses += [] if lost is None else [lost]
        is_tree = {w: F.coalesce(F.col(f"{w}_mode") == DIRECTORY, F.lit(False)) for w in ("old", "new")}
        file = {w: F.when(~is_tree[w], F.col(f"{w}_oid")) for w in ("old", "new")}
        files = rows.select("id", "path", file["old"].alias("before"), file["new"].alias("after"))
        files, lost = _within(files.where("before is not null or after is not null"), used, "shown", max_paths, "paths", "changed")
        losses += [] if lost is None else [lost]
        found.append(files)
        more = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(files.groupBy("id").agg(F.count(F.lit(1)).alias("f")), "id", "left")
        used = used.join(more, "id", "left").select("id", (F.col("used") + F.coalesce("n", F.lit(0))).alias("used"), (F.col("shown") + F.coalesce("f", F.lit(0))).alias("shown"))
        used = materialize(used, "used", compact=True)
        tree = {w: F.when(is_tree[w], F.col(f"{w}_oid")).alias(w) for w in ("old", "new")}
        frontier = materialize(rows.where(is_tree["old"] | is_tree["new"]).select("id", F.concat("path", F.lit("/")).alias("at"), tree["old"], tree["new"]).where("not (old <=> new)"), "frontier", compact=True)
    out = found[0] if found else pairs.select("id", F.lit("").alias("path"), F.lit("").alias("before"), F.lit("").alias("after")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out, _summed(losses, spark)
