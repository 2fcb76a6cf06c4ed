"""Project roots and landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions import landmarks as L
from wayfind.functions import paths as P
from wayfind.schemas import LANDMARK_PRIORITIES
from wayfind.settings import MapSettings


def project_roots(files: DataFrame) -> DataFrame:
    """(path, kind, manifests) for each directory with manifests; ``files`` has path and content.

    More than one ecosystem is mixed; else any unreadable manifest is unknown, any workspace
    marker is workspace, and what is left is package.
    """
    name = F.lower(P.basename(F.col("path")))
    found = files.where(L.is_manifest(name)).select(
        P.parent(F.col("path")).alias("root"), F.col("path").alias("manifest"), L.manifest_family(name).alias("family"), L.manifest_role(name, F.col("content").cast("string")).alias("role")
    )
    grouped = found.groupBy("root").agg(F.array_sort(F.collect_set("manifest")).alias("manifests"), F.collect_set("family").alias("f"), F.collect_set("role").alias("r"))
    kind = F.when(F.size("f") > 1, "mixed").when(F.array_contains("r", "unknown"), "unknown").when(F.array_contains("r", "workspace"), "workspace").otherwise("package")
    return grouped.select(F.col("root").alias("path"), kind.alias("kind"), "manifests")


def deepest_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with project_root: the longest root that is the path's directory or above it.

    Each path is joined by its ancestors, so a prefix match is an equality; a path keeps one
    row whatever the number of its roots.
    """
    known = roots.select(F.col("path").alias("_root")).distinct()
    up = rows.select("path").distinct().select("path", F.explode(P.ancestors(F.col("path"), itself=True)).alias("_a"))
    found = up.join(known, F.col("_a") == F.col("_root")).groupBy("path").agg(F.max_by("_root", F.when(F.col("_root") == ".", 0).otherwise(F.length("_root"))).alias("project_root"))
    return rows.join(found, "path", "left")


def directory_states(states: DataFrame) -> DataFrame:
    """(path, state) of each directory: of what is below it, modified, untracked, tracked, unknown in that order."""
    order = F.array_position(F.array(*map(F.lit, ("modified", "untracked", "tracked", "unknown"))), F.col("state"))
    up = states.select(order.alias("o"), F.explode(P.ancestors(F.col("path"))).alias("path"))
    best = up.groupBy("path").agg(F.min("o").cast("int").alias("o"))
    return best.select("path", F.element_at(F.array(*map(F.lit, ("modified", "untracked", "tracked", "unknown"))), F.col("o")).alias("state"))


def declared_submodules(gitmodules: DataFrame) -> DataFrame:
    """(path) from the ``path = x`` lines of a .gitmodules text in column content."""
    lines = gitmodules.select(F.explode(F.split("content", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*path\s*="))
    return lines.select(F.trim(F.regexp_replace("line", r"^\s*path\s*=", "")).alias("path")).where("path <> ''").distinct()


def nested_repositories(listing: DataFrame) -> DataFrame:
    """(path) of directories other than the root that hold .git; those inside another are left to it."""
    found = listing.where(F.col("path").endswith("/.git")).select(P.parent(F.col("path")).alias("path")).distinct()
    inner = found.select(F.col("path").alias("p"), F.explode(P.ancestors(F.col("path"))).alias("a")).join(found.select(F.col("path").alias("_f")), F.col("a") == F.col("_f")).select("p").distinct()
    return found.join(inner, F.col("path") == F.col("p"), "left_anti")


def _priority(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANDMARK_PRIORITIES.items() for x in pair))
    return F.element_at(table, kind)


def landmarks(files: DataFrame, roots: DataFrame, settings: MapSettings, submodules: DataFrame | None = None, nested: DataFrame | None = None) -> DataFrame:
    """All landmarks, one for each kind and path, best first; ``files`` has path and state.

    Where two sources give one landmark the first counts: roots, files, directories, then
    submodules and nested repositories.
    """
    add = lambda df, source, kind, reason: df.select(F.lit(source).alias("source"), kind.alias("kind"), "path", reason.alias("reason"))
    manifest = lambda: F.element_at("manifests", 1)
    rooted = roots.select("kind", manifest().alias("path")).withColumn("k", F.when(F.col("kind") == "workspace", "workspace_root").otherwise("package_root"))
    found = add(rooted, 0, F.col("k"), F.concat(F.lit("project root: "), F.col("kind")))
    named = files.select("path", F.explode(L.file_landmarks(F.col("path"))).alias("k"))
    found = found.unionAll(add(named, 1, F.col("k"), F.lit("file name")))
    dirs = files.select(F.explode(P.ancestors(F.col("path"))).alias("path")).where("path <> '.'").distinct()
    found = found.unionAll(add(dirs.where(L.is_test_directory(P.basename(F.col("path")))), 2, F.lit("test_root"), F.lit("directory name")))
    found = found.unionAll(add(dirs.where(L.is_ci_directory(F.col("path"))), 2, F.lit("ci"), F.lit("directory name")))
    for more, kind in ((submodules, "submodule"), (nested, "nested_repository")):
        if more is not None:
            found = found.unionAll(add(more, 3, F.lit(kind), F.lit("repository inside the repository")))
    one = found.groupBy("kind", "path").agg(F.min_by("reason", "source").alias("reason"))
    state = files.select("path", F.col("state").alias("worktree_state")).unionAll(directory_states(files).select("path", F.col("state").alias("worktree_state"))).groupBy("path").agg(F.min("worktree_state").alias("worktree_state"))
    terms = [t.strip().lower() for t in settings.focuses if t.strip()]
    focus = sum((F.lower("path").contains(t).cast("int") for t in terms), P.focus_includes(F.col("path"), settings.focus_paths).cast("int"))
    out = deepest_root(one, roots).join(state, "path", "left").select(
        "kind", "path", "reason", "project_root", F.coalesce("worktree_state", F.lit("unknown")).alias("worktree_state"),
        _priority(F.col("kind")).alias("priority"), focus.alias("focus_matches"),
    )
    return out.orderBy(F.col("priority").desc(), F.col("focus_matches").desc(), "path", "kind")


def root_totals(roots: DataFrame, marks: DataFrame, recommendations: DataFrame) -> DataFrame:
    """``roots`` with how many landmarks and recommendations lie in each, and the latter's paths in order."""
    n = marks.groupBy(F.col("project_root").alias("path")).agg(F.count(F.lit(1)).alias("landmark_total"))
    r = recommendations.groupBy(F.col("project_root").alias("path")).agg(
        F.count(F.lit(1)).alias("recommendation_total"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("path").alias("p")))), lambda x: x["p"]).alias("recommended_paths")
    )
    joined = roots.join(n, "path", "left").join(r, "path", "left")
    return joined.na.fill({"landmark_total": 0, "recommendation_total": 0}).withColumn("recommended_paths", F.coalesce("recommended_paths", F.array().cast("array<string>")))
