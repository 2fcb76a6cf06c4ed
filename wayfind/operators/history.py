"""Signals in a commit history: churn, contributors, bugs, activity, firefighting.

``commits`` has seq (newest first), id, parents, author_name, author_email, author_seconds,
committer_seconds and message; ``commit_paths`` has id and path, one row for each path that
a commit changed against its first parent (none for merges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import paths as P
from wayfind.functions import text as X
from wayfind.settings import HistorySettings


def scoped_commits(commits: DataFrame, commit_paths: DataFrame, scope: str) -> DataFrame:
    """Commits that change a path in scope; "." takes all, merges too."""
    if scope in ("", "."):
        return commits
    touched = commit_paths.where(P.in_scope(F.col("path"), scope)).select("id").distinct()
    return commits.join(touched, "id", "left_semi")


def collected(commits: DataFrame, max_commits: int) -> DataFrame:
    """The newest commits by committer time, then seq, up to the ceiling."""
    return commits.orderBy(F.col("committer_seconds").desc(), "seq").limit(max_commits)


def commit_counts(commits: DataFrame) -> DataFrame:
    """(commits_seen, non_merge_commits_seen)."""
    return commits.agg(F.count(F.lit(1)).alias("commits_seen"), F.count_if(~X.is_merge(F.col("parents"))).alias("non_merge_commits_seen"))


def observed_range(commits: DataFrame) -> DataFrame:
    """(first_seconds, last_seconds) of committer times."""
    return commits.agg(F.min("committer_seconds").alias("first_seconds"), F.max("committer_seconds").alias("last_seconds"))


def _windowed(commits: DataFrame, settings: HistorySettings) -> DataFrame:
    return commits.where(~X.is_merge(F.col("parents")) & X.in_window(F.col("committer_seconds"), settings.now, settings.days))


def _count_paths(chosen: DataFrame, commit_paths: DataFrame, scope: str) -> DataFrame:
    in_scope = commit_paths.where(P.in_scope(F.col("path"), scope))
    return in_scope.join(chosen.select("id"), "id", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def churn(commits: DataFrame, commit_paths: DataFrame, settings: HistorySettings) -> DataFrame:
    """(path, commits): how many non-merge commits of the window changed each path in scope."""
    return _count_paths(_windowed(commits, settings), commit_paths, settings.scope)


def order_paths(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("commits").desc(), "path")


def identities(commits: DataFrame, mailmap: DataFrame | None = None) -> DataFrame:
    """``commits`` with canonical_name and canonical_email.

    Names are trimmed, an empty one is Unknown; emails are trimmed and lower-cased. A mailmap
    entry with name and email comes before one with the email alone; both ignore case.
    """
    name = F.trim(F.col("author_name"))
    raw = commits.withColumns({"raw_name": F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(name), "raw_email": F.lower(F.trim(F.col("author_email")))})
    if mailmap is None:
        return raw.withColumns({"canonical_name": F.col("raw_name"), "canonical_email": F.col("raw_email")})
    entry = F.struct(F.coalesce("proper_name", F.lit("")).alias("name"), F.coalesce("proper_email", F.lit("")).alias("email"))
    key = mailmap.select(F.lower(F.trim("commit_email")).alias("_email"), F.lower(F.trim("commit_name")).alias("_name"), entry.alias("m"))
    by_both = key.where("_name is not null and _name <> ''").groupBy("_email", "_name").agg(F.min("m").alias("both"))
    by_email = key.where("_name is null or _name = ''").groupBy(F.col("_email").alias("_email2")).agg(F.min("m").alias("alone"))
    found = raw.join(by_both, (F.col("raw_email") == F.col("_email")) & (F.lower("raw_name") == F.col("_name")), "left")
    found = found.join(by_email, F.col("raw_email") == F.col("_email2"), "left").drop("_email", "_name", "_email2")
    entry = F.coalesce("both", "alone")
    filled = lambda part, raw_col: F.when(F.coalesce(entry[part], F.lit("")) == "", F.col(raw_col)).otherwise(entry[part])
    return found.withColumns({"canonical_name": F.trim(filled("name", "raw_name")), "canonical_email": F.lower(F.trim(filled("email", "raw_email")))}).drop("both", "alone")


def identity_mappings(identified: DataFrame, include_emails: bool = False) -> DataFrame:
    """Distinct raw identities that differ from their canonical ones, ordered."""
    email = lambda c: F.col(c) if include_emails else F.lit(None).cast("string").alias(c)
    differs = (F.col("raw_name") != F.col("canonical_name")) | ~F.col("raw_email").eqNullSafe(F.col("canonical_email"))
    out = identified.where(differs).select("raw_name", email("raw_email"), "canonical_name", email("canonical_email")).distinct()
    return out.orderBy("raw_name", "raw_email", "canonical_name", "canonical_email")


def contributors(identified: DataFrame, settings: HistorySettings, recent: bool = False) -> DataFrame:
    """(name, email, commits, share_percent) of non-merge commits, in order of commits.

    People are told apart by email, else by name; the newest commit's spelling shows. The
    recent list goes by author time.
    """
    chosen = identified.where(~X.is_merge(F.col("parents")))
    if recent:
        chosen = chosen.where(X.in_window(F.col("author_seconds"), settings.now, settings.recent_days))
    key = F.lower(F.when(F.coalesce("canonical_email", F.lit("")) != "", F.col("canonical_email")).otherwise(F.col("canonical_name")))
    grouped = chosen.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("commits"), F.min_by("canonical_name", "seq").alias("name"), F.min_by("canonical_email", "seq").alias("email")
    )
    total = F.sum("commits").over(Window.partitionBy())
    email = F.col("email") if settings.include_emails else F.lit(None).cast("string")
    out = grouped.select("name", email.alias("email"), "commits", X.share_percent(F.col("commits"), total).alias("share_percent"))
    return out.orderBy(F.col("commits").desc(), F.col("email").asc_nulls_first(), "name")


def evidence_commits(commits: DataFrame, commit_paths: DataFrame, settings: HistorySettings, keywords: tuple[str, ...]) -> DataFrame:
    """(seq, id, subject, paths, matched_terms): commits of the window that match a keyword and change a path in scope."""
    terms = X.matched_keywords(F.col("message"), keywords, settings.substring)
    hits = _windowed(commits, settings).withColumn("matched_terms", terms).where(F.size("matched_terms") > 0)
    scoped = commit_paths.where(P.in_scope(F.col("path"), settings.scope)).join(hits.select("id"), "id", "left_semi")
    listed = scoped.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    subject = F.split_part(F.col("message"), F.lit("\n"), F.lit(1))
    return hits.join(listed, "id").select("seq", "id", subject.alias("subject"), "paths", "matched_terms").orderBy("seq")


def keyword_paths(commits: DataFrame, commit_paths: DataFrame, settings: HistorySettings, keywords: tuple[str, ...]) -> DataFrame:
    """(path, commits) over the commits that match a keyword."""
    terms = X.matched_keywords(F.col("message"), keywords, settings.substring)
    return _count_paths(_windowed(commits, settings).where(F.size(terms) > 0), commit_paths, settings.scope)


def bug_overlap(bugs: DataFrame, churned: DataFrame) -> DataFrame:
    """Bug paths that churn too, with their bug counts."""
    return bugs.join(churned.select("path"), "path", "left_semi")


def activity(commits: DataFrame) -> DataFrame:
    """(month, commits) by author time in UTC, merges included."""
    return commits.groupBy(X.month(F.col("author_seconds")).alias("month")).agg(F.count(F.lit(1)).alias("commits")).orderBy("month")


def busiest_month(months: DataFrame) -> DataFrame:
    """The month with most commits; of equals the latest."""
    return months.agg(F.max_by("month", F.struct("commits", "month")).alias("month"), F.max("commits").alias("commits"))


def head_sizes(counts: DataFrame, blobs: DataFrame, settings: HistorySettings, top: int) -> DataFrame:
    """Size, status and churn rate of the first ``top`` paths.

    ``blobs`` has path and content (string or binary) at HEAD. In order of churn: missing,
    empty, oversized, beyond the total ceiling (and passed over), binary, generated, text.
    """
    first = order_paths(counts).limit(top)
    size = F.octet_length("content")
    joined = first.join(blobs.select("path", "content"), "path", "left").select(
        "path", "commits", size.cast("long").alias("size"), X.binary(F.col("content").cast("binary")).alias("is_binary"),
        X.looks_generated(F.col("path"), F.col("content").cast("string")).alias("is_generated"),
    )
    limits = settings.limits
    rows = F.array_sort(F.collect_list(F.struct((-F.col("commits")).alias("o"), "path", "commits", "size", "is_binary", "is_generated")))
    kind = "array<struct<path:string,commits:bigint,size_bytes:bigint,size_status:string>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["size"] <= limits.source_bytes
        status = (
            F.when(r["size"].isNull(), "missing_at_head").when(r["size"] == 0, "empty").when(r["size"] > limits.file_bytes, "oversized")
            .when(~fits, "resource_limit").when(r["is_binary"], "binary").when(r["is_generated"], "generated").otherwise("text")
        )
        used = F.when(status.isin("binary", "generated", "text"), acc["used"] + r["size"]).otherwise(acc["used"])
        row = F.struct(r["path"].alias("path"), r["commits"].alias("commits"), r["size"].alias("size_bytes"), status.alias("size_status"))
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = joined.agg(rows.alias("rows")).select(F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("r")).select("r.*")
    rate = F.when(F.col("size_status").isin("generated", "text"), X.churn_rate(F.col("commits"), F.col("size_bytes")))
    return folded.select("path", "commits", "size_bytes", rate.alias("commits_per_kib_milli"), "size_status")


def completeness(shallow: bool, missing_objects: int, losses: dict[str, int]) -> dict[str, object]:
    """Status by precedence, and whether counts can be relied on.

    ``losses`` counts what the scan of commits and paths left out, by reason. What a report does not
    show for want of room is no loss: its counts are still right.
    """
    lost = {k: n for k, n in losses.items() if n}
    status = "missing_objects" if missing_objects or lost.get("unread_commits") else "shallow" if shallow else "partial" if lost else "complete"
    return {"status": status, "authoritative": status == "complete"} | ({"losses": lost} if lost else {})


def observations(report: dict[str, list[dict]], totals: dict[str, int]) -> list[dict[str, object]]:
    """At most five observations, from the bounded collections of a report.

    ``report`` has churn, contributors_recent, contributors_overall, bug_overlap, activity and
    firefighting rows; ``totals`` the sizes of the lists before they were bounded.
    """
    out: list[dict[str, object]] = []
    cut = lambda name: totals.get(name, 0) > len(report.get(name, ()))
    rows = report.get("churn", [])
    if rows and (rows[0]["commits"] >= 2 or len(rows) >= 2):
        out.append({"kind": "churn", "paths": rows[:3]})
    recent = report.get("contributors_recent", [])
    which = "contributors_recent" if recent and recent[0]["commits"] >= 2 else "contributors_overall"
    people = report.get(which, [])
    if people and not cut(which) and people[0]["commits"] >= 2 and sum(p["commits"] for p in people) >= 2:
        out.append({"kind": "contributors", "window": which.rpartition("_")[2], "top": people[0], "total": sum(p["commits"] for p in people)})
    if report.get("bug_overlap") and totals.get("bug_commits", 0) > 0:
        out.append({"kind": "bug_overlap", "paths": report["bug_overlap"][:3], "commits": totals["bug_commits"]})
    months = report.get("activity", [])
    if len(months) >= 2 and not cut("activity") and sum(m["commits"] for m in months) >= 3:
        out.append({"kind": "activity", "busiest": max(months, key=lambda m: (m["commits"], m["month"])), "months": len(months)})
    fires = report.get("firefighting", [])
    if fires:
        counts: dict[str, int] = {}
        for row in fires:
            for p in row["paths"]:
                counts[p] = counts.get(p, 0) + 1
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]
        out.append({"kind": "firefighting", "paths": [{"path": p, "commits": n} for p, n in top], "commits": totals.get("firefighting", len(fires))})
    return out
