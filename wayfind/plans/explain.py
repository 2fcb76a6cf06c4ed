"""What a map and a history say about one path or symbol, and how far a report can be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.functions.labels import actionable_limitation, explained_landmark
from wayfind.functions.modules import qualified
from wayfind.functions.paths import focus_includes

MOST = {"symbols": 128, "edges": 128, "ambiguity": 64, "omissions": 32}

# Quality issues in their order.
ISSUES = ("stale", "resource_limit", "incomplete", "unsafe_path", "unsupported", "partial")
IGNORED_LIMITATION = "The per-file symbol limit"


def target_kind(target: str, files: DataFrame, omissions: DataFrame, symbols: DataFrame) -> str:
    """path, symbol or unmatched."""
    plain = target.strip().removeprefix("./").rstrip("/")
    if not plain:
        raise ValueError("the target is empty")
    known = files.select("path").unionAll(omissions.select("path")).where(F.col("path") == plain)
    if known.limit(1).count() or ("/" in plain and "." in plain.rsplit("/", 1)[1]):
        return "path"
    named = symbols.where((F.col("name") == plain) | (qualified(F.col("scope"), F.col("name")) == plain))
    return "symbol" if named.limit(1).count() else "unmatched"


def explain(target: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, ranking: DataFrame, findings: DataFrame, omissions: DataFrame, churn: DataFrame, bugs: DataFrame) -> dict[str, DataFrame | str]:
    """The relations of a report that bear on a target, each up to its ceiling and in order.

    An edge bears on it by its source, its target or its symbol; a path of the history comes
    once, from churn first.
    """
    plain = target.strip().removeprefix("./").rstrip("/")
    kind = target_kind(target, files, omissions, symbols)
    own = F.col("path") == plain if kind == "path" else (F.col("name") == plain) | (qualified(F.col("scope"), F.col("name")) == plain)
    matched = symbols.where(own if kind != "unmatched" else F.lit(False))
    paths = (matched.select("path") if kind == "symbol" else files.where(F.col("path") == plain).select("path") if kind == "path" else files.select("path").limit(0)).distinct()
    ends = [edges.join(paths.withColumnRenamed("path", end), end, "left_semi") for end in ("source", "target")]
    by_name = edges.join(matched.select(F.col("name").alias("symbol")).distinct(), "symbol", "left_semi") if kind == "symbol" else edges.limit(0)
    touching = reduce(DataFrame.unionByName, [*ends, by_name]).dropDuplicates(["source", "target", "symbol", "candidate_group"])
    history = churn.select("path", "commits", F.lit(0).alias("o"), F.lit("churn").alias("signal")).unionAll(bugs.select("path", "commits", F.lit(1), F.lit("bug_overlap")))
    history = history.join(paths, "path", "left_semi").groupBy("path").agg(F.min_by(F.struct("commits", "signal"), "o").alias("h")).select("path", "h.*")
    lost = omissions.where(F.col("path") == plain) if kind == "path" else omissions if kind == "unmatched" else omissions.limit(0)
    return {
        "kind": kind,
        "symbols": matched.orderBy("path", "seq").limit(MOST["symbols"]),
        "ranking": ranking.join(paths, "path", "left_semi"),
        "edges": touching.orderBy("source", "target", "symbol").limit(MOST["edges"]),
        "ambiguity": touching.where("ambiguous").select("candidate_group", "source", "symbol").distinct().orderBy("candidate_group").limit(MOST["ambiguity"]),
        "findings": findings.join(paths, "path", "left_semi"),
        "history": history.orderBy("path"),
        "omissions": lost.orderBy("path", "reason").limit(MOST["omissions"]),
        "landmarks": paths.select("path", explained_landmark(F.col("path")).alias("kind")).where("kind is not null"),
    }


def quality(relevant: DataFrame | None, files: DataFrame, omissions: DataFrame, stale: bool, history_complete: bool, focus_paths: tuple[str, ...] = ()) -> DataFrame:
    """One row of flags, and the issues that a strict run fails on, in their fixed order.

    ``relevant`` are the paths that matter (None: all). ``files`` has path, status,
    limitations and cache_status.
    """
    keep = lambda df: df if relevant is None else df.join(relevant.select("path").distinct(), "path", "left_semi")
    real = F.exists("limitations", lambda x: ~x.startswith(IGNORED_LIMITATION))
    limited = F.exists("limitations", actionable_limitation)
    of_files = keep(files).agg(
        F.coalesce(F.bool_or((F.col("status") == "partial") & (real | (F.size("limitations") == 0))), F.lit(False)).alias("partial"),
        F.coalesce(F.bool_or(F.col("cache_status") == "stale"), F.lit(False)).alias("old"), F.coalesce(F.bool_or(limited), F.lit(False)).alias("cut"),
    )
    has = lambda *reasons: F.coalesce(F.bool_or(F.col("reason").isin(*reasons)), F.lit(False))
    mine = keep(omissions).agg(has("unsupported_language").alias("unsupported"), has("cache_unavailable").alias("unavailable"))
    every = omissions.agg(has("traversal_error", "oversized").alias("over"), has("unsafe_path").alias("unsafe"))
    flags = of_files.join(F.broadcast(mine)).join(F.broadcast(every))  # one row each
    named = {
        "stale": F.col("old") | F.lit(stale), "resource_limit": F.col("over") | F.col("cut"), "incomplete": F.col("unavailable") | F.lit(not history_complete),
        "unsafe_path": F.col("unsafe"), "unsupported": F.col("unsupported"), "partial": F.col("partial"),
    }
    return flags.select(*(named[i].alias(i) for i in ISSUES), F.array_compact(F.array(*(F.when(named[i], F.lit(i)) for i in ISSUES))).alias("issues"))


def relevant_paths(plan: DataFrame | None, matches: DataFrame | None, files: DataFrame, focus_paths: tuple[str, ...]) -> DataFrame | None:
    """Recommended, matched and focused paths; None (all) if nothing is selected."""
    parts = [df.select("path") for df in (plan, matches) if df is not None]
    if focus_paths:
        parts.append(files.where(focus_includes(F.col("path"), focus_paths)).select("path"))
    return reduce(DataFrame.unionAll, parts).distinct() if parts else None
