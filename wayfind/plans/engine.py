"""The commands: history, source map, briefing, explain and cache control over a repository."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import cache, graph, history, inventory, landmarks, selection
from wayfind.plans import explain as explaining
from wayfind.plans import reading, report
from wayfind.settings import HistorySettings, MapSettings
from wayfind.sources import git, parser, worktree
from wayfind.sources.snapshots import Snapshots
from wayfind.storage import materialize


@dataclass
class Repository:
    """One repository's relations, read once and shared by all commands."""

    spark: SparkSession
    path: str
    map_settings: MapSettings
    history_settings: HistorySettings
    #: A table of parse records; without one nothing is looked up or kept.
    cache_path: str | None = None

    @cached_property
    def top(self) -> str:
        return git.discover(self.path)

    # --- history --------------------------------------------------------------------------

    @cached_property
    def all_commits(self) -> DataFrame:
        raw = git.read(self.spark, "git_commits", self.top, max_commits=self.history_settings.limits.commits)
        rows = [r for r in git.committed_mailmap(self.top)]
        mailmap = self.spark.createDataFrame(rows, "proper_name string, proper_email string, commit_name string, commit_email string") if rows else None
        return materialize(history.identities(raw, mailmap), "commits")

    @cached_property
    def commit_paths(self) -> DataFrame:
        return self.read_paths.where("path is not null").select("id", "path")

    @cached_property
    def read_paths(self) -> DataFrame:
        """Changed paths, and rows without one for what the source could not show."""
        return materialize(git.read(self.spark, "git_paths", self.top), "commit-paths")

    @cached_property
    def losses(self) -> dict[str, int]:
        """What the sources left out: commits over the ceiling, paths over a commit's, commits whose trees cannot be read."""
        lost = self.read_paths.where("path is null").agg(F.sum(F.greatest("lost", F.lit(0))).alias("paths"), F.count_if(F.col("lost") < 0).alias("unread")).first()
        over = max(0, git.commit_count(self.top) - self.history_settings.limits.commits)
        return {"commits": over, "paths": lost["paths"] or 0, "unread_commits": lost["unread"]}

    @cached_property
    def commits(self) -> DataFrame:
        return history.scoped_commits(self.all_commits, self.commit_paths, self.history_settings.scope)

    @cached_property
    def churn(self) -> DataFrame:
        return materialize(history.churn(self.commits, self.commit_paths, self.history_settings), "churn")

    def history(self) -> dict[str, object]:
        """All history signals, bounded, with their summaries and observations."""
        s, most = self.history_settings, self.history_settings.limits.history_items
        bugs = history.keyword_paths(self.commits, self.commit_paths, s, s.bug_keywords)
        blobs = git.read(self.spark, "git_tree", self.top, content=True).select("path", "content")
        parts = {
            "churn": history.order_paths(self.churn),
            "contributors_overall": history.contributors(self.commits, s),
            "contributors_recent": history.contributors(self.commits, s, recent=True),
            "bug_overlap": history.order_paths(history.bug_overlap(bugs, self.churn)),
            "bug_commits": history.evidence_commits(self.commits, self.commit_paths, s, s.bug_keywords),
            "firefighting": history.evidence_commits(self.commits, self.commit_paths, s, s.firefighting_keywords),
            "activity": history.activity(self.commits),
            "identities": history.identity_mappings(self.commits, s.include_emails),
        }
        out: dict[str, object] = {"title": "History", "counts": report.rows_of(history.commit_counts(self.commits))[0], "observed": report.rows_of(history.observed_range(self.commits))[0]}
        rows, sums = {}, {}
        for name, df in parts.items():
            rows[name], sums[name] = report.bounded(df, most)
        rows["churn_sizes"] = report.rows_of(history.head_sizes(self.churn, blobs, s, most))
        out |= rows | {"collections": sums}
        out["completeness"] = history.completeness(git.is_shallow(self.top), git.missing_objects(self.top), self.losses)
        out["observations"] = history.observations(rows, {k: v["total"] for k, v in sums.items()})
        return out

    # --- map ------------------------------------------------------------------------------

    @cached_property
    def worktree(self) -> DataFrame:
        return materialize(worktree.read(self.spark, self.top, self.map_settings.limits.file_bytes), "worktree")

    @cached_property
    def submodules(self) -> DataFrame:
        """Paths that .gitmodules declares or the index holds as repositories."""
        declared = landmarks.declared_submodules(self.worktree.where("path = '.gitmodules'").select(F.col("content").cast("string").alias("content")))
        held = git.read(self.spark, "git_index", self.top).where("mode = '160000'").select("path")
        return materialize(declared.unionAll(held).distinct(), "submodules", compact=True)

    @cached_property
    def nested(self) -> DataFrame:
        """Repositories inside the repository that are no submodules."""
        listing = self.spark.createDataFrame([(p,) for p in worktree.git_folders(self.top)], "path string")
        return landmarks.nested_repositories(listing).join(self.submodules, "path", "left_anti")

    @cached_property
    def found(self) -> DataFrame:
        """Tracked and visible paths in scope, with state and symlink flag."""
        index = git.read(self.spark, "git_index", self.top, content=True)
        links = index.select("path", (F.col("mode") == "120000").alias("symlink"), "mode", "content")
        changed = inventory.modified_paths(links.where("mode <> '160000'"), self.worktree)
        found = inventory.candidates(links.select("path", "symlink"), changed, self.worktree.where("not ignored").select("path", "symlink"), self.submodules)
        return materialize(found.where(inventory.P.in_scope(F.col("path"), self.map_settings.scope)), "found")

    @cached_property
    def candidates(self) -> DataFrame:
        joined = self.found.join(self.worktree.select("path", "content"), "path", "left")
        return materialize(inventory.gated(joined, self.map_settings), "candidates")

    @cached_property
    def eligible(self) -> DataFrame:
        """Files that pass every gate, up to the ceilings on files and bytes."""
        s = self.map_settings.limits
        passed = self.candidates.where("omission_reason is null").orderBy("path").limit(s.files)
        sized = passed.select("path", F.octet_length("content").cast("long").alias("size"))
        kept = inventory.greedy_rounds(sized, [], ["path"], "size", s.source_bytes).where("kept").select("path")
        return materialize(passed.join(kept, "path", "left_semi").withColumnRenamed("state", "worktree_state"), "eligible")

    @cached_property
    def cache_requests(self) -> DataFrame:
        """(path, matched) of the files that the caller named for the cache."""
        named = self.spark.createDataFrame([(p,) for p in self.map_settings.cache_files], "named string")
        asked = named.select(inventory.P.normalize_relative(F.col("named")).alias("path")).where("path is not null")
        return inventory.cache_requests(asked, self.eligible)

    @cached_property
    def parsed(self) -> DataFrame:
        """Every eligible file with its cache_status and what was found in it; what was parsed now is added to the cache."""
        s, digest = self.map_settings, hashlib.sha256(self.top.encode()).hexdigest()
        keys = [F.lit(digest).alias("repository_id"), "path", "language", F.lit(parser.query_digest()).alias("query_digest"), cache.fingerprint(F.col("content")).alias("fingerprint")]
        mode = s.cache_mode if self.cache_path or s.cache_mode in ("manual", "files") else "no_cache"
        records = cache_records(self.spark, self.cache_path)
        looked = materialize(cache.plan(self.eligible.select(*keys, "worktree_state", "content"), records, mode, self.cache_requests.where("matched")), "looked")
        known = F.col("payload").isNotNull() | (F.col("cache_status") == "unavailable")
        made = parser.parse_payloads(looked.where(~known).drop("payload"), s.limits.symbols_per_file)
        every = materialize(looked.where(known).drop("content").unionByName(made), "payloads")
        if self.cache_path and mode != "no_cache":
            now = F.timestamp_seconds(F.lit(self.history_settings.now))
            Snapshots(self.spark, self.cache_path, cache.RECORDS).append(cache.records_of(every.where(F.col("cache_status").isin("refreshed", "forced")), now))
        return materialize(parser.read_payload(every).drop("payload"), "parsed")

    @cached_property
    def sources(self) -> DataFrame:
        """The files that the map is about."""
        held = self.parsed.where("cache_status <> 'unavailable'")
        return held.select("path", "language", "worktree_state", "cache_status", F.coalesce("parsed.status", F.lit("complete")).alias("status"), F.coalesce("parsed.limitations", F.array().cast("array<string>")).alias("limitations"))

    @cached_property
    def omissions(self) -> DataFrame:
        gates = self.candidates.where("omission_reason is not null").select("path", F.col("omission_reason").alias("reason"))
        ignored = inventory.ignored_paths(self.worktree.where(inventory.P.in_scope(F.col("path"), self.map_settings.scope)), self.found)
        unavailable = self.parsed.where("cache_status = 'unavailable'").select("path", F.lit("cache_unavailable").alias("reason"))
        return gates.unionAll(ignored.select("path", F.lit("ignored_untracked").alias("reason"))).unionAll(unavailable).orderBy("path", "reason")

    @cached_property
    def symbols(self) -> DataFrame:
        s = self.map_settings.limits
        return materialize(graph.first_per_order(parser.symbols_of(self.parsed), ["path", "seq"], s.symbols_total), "symbols")

    @cached_property
    def findings(self) -> DataFrame:
        broken = parser.findings_of(self.parsed)
        groups = graph.ambiguity_groups(self.edges)
        return broken.unionByName(groups.select("path", F.lit("ambiguous_reference").alias("kind"), F.lit(None).cast("int").alias("line"), F.concat("symbol", F.lit(" may mean "), "candidates", F.lit(" files")).alias("detail")))

    @cached_property
    def edges(self) -> DataFrame:
        s = self.map_settings.limits
        return materialize(graph.lexical_edges(self.symbols, s.candidates, s.edges), "edges")

    @cached_property
    def ranking(self) -> DataFrame:
        s = self.map_settings
        ranks = graph.page_rank(self.sources.select("path"), graph.weighted_edges(self.edges))
        return materialize(graph.file_ranking(ranks, graph.focus_matches(self.symbols, self.sources, s.focuses, s.focus_paths)), "ranking")

    @cached_property
    def roots(self) -> DataFrame:
        return materialize(landmarks.project_roots(self.candidates.select("path", "content")), "roots")

    @cached_property
    def landmarks(self) -> DataFrame:
        files = self.candidates.where("coalesce(omission_reason, '') not in ('explicit_exclusion', 'unsafe_path')").select("path", "state")
        return materialize(landmarks.landmarks(files, self.roots, self.map_settings, self.submodules, self.nested), "landmarks")

    def recommendations(self, plan: dict | None) -> DataFrame:
        rows = [(r["ordinal"], r["path"], r["project_root"]) for r in (plan or {}).get("recommendations", ())]
        return self.spark.createDataFrame(rows, "ordinal int, path string, project_root string")

    def cache_stats(self) -> dict[str, object]:
        """What the cache did for this run."""
        n = report.rows_of(cache.stats(self.parsed))[0]
        asked = report.rows_of(self.cache_requests.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched")))[0]
        mode = self.map_settings.cache_mode if self.cache_path else "no_cache"
        return {"status": cache.overall_status(mode, n["hits"], n["refreshed"], n["stale"]), **n, **asked}

    def quality(self, plan: DataFrame | None = None, matches: DataFrame | None = None, history_complete: bool = True) -> dict[str, object]:
        """The flags and issues of what this report is about."""
        relevant = explaining.relevant_paths(plan, matches, self.sources, self.map_settings.focus_paths)
        return report.rows_of(explaining.quality(relevant, self.sources, self.omissions, False, history_complete))[0]

    def map(self, plan: dict | None = None) -> dict[str, object]:
        """The source map, bounded by its profile."""
        s = self.map_settings
        counts = graph.reference_counts(self.edges)
        chosen = selection.select_snippets(graph.snippet_scores(self.symbols, self.ranking, counts, s.focuses), s.selection_budget)
        shown = selection.project(
            {
                "files": self.sources, "omissions": self.omissions, "ranking": self.ranking, "landmarks": self.landmarks, "project_roots": landmarks.root_totals(self.roots, self.landmarks, self.recommendations(plan)),
                "edges": self.edges, "findings": self.findings,
            },
            s.profile,
            {"files": ["path"], "ranking": [F.col("score").desc(), "path"], "edges": ["source", "target", "symbol"], "findings": ["path", "line", "kind"], "project_roots": ["path"],
             "landmarks": [F.col("priority").desc(), F.col("focus_matches").desc(), "path", "kind"], "omissions": ["path", "reason"]},
        )
        rows = {k: report.rows_of(df) for k, df in shown.items()} | {"snippets": chosen["snippets"]}
        if s.profile == "compact" and s.tokens < 256:
            rows = selection.shrink(rows, s.tokens)
        elif s.profile == "evidence":
            rows = selection.halve(rows, 4 << 20)
        return {"title": "Source map", "inventory": report.rows_of(inventory.inventory(self.candidates))[0], **rows, "selection": {k: chosen[k] for k in ("token_budget", "estimated_tokens")},
                "classifications": report.rows_of(inventory.classification_summary(self.candidates))[0], "cache": self.cache_stats(),
                "availability": inventory.availability(self.sources, self.omissions), "quality": self.quality()}

    # --- both -----------------------------------------------------------------------------

    def reading_plan(self, fill_order: str = "weakest") -> dict[str, object]:
        s = self.history_settings
        bugs = history.keyword_paths(self.commits, self.commit_paths, s, s.bug_keywords)
        fires = history.keyword_paths(self.commits, self.commit_paths, s, s.firefighting_keywords)
        files = self.sources.select("path", "limitations")
        rows = reading.candidate_rows(files, self.ranking, graph.degrees(self.edges), self.landmarks, self.roots, self.omissions, self.churn, history.bug_overlap(bugs, self.churn), fires)
        candidates = materialize(reading.with_manifests(reading.combine(rows), self.roots), "candidates")
        return reading.choose(reading.shortlist(candidates), report.rows_of(self.roots.orderBy("path")), fill_order)

    def briefing(self) -> dict[str, object]:
        plan, past = self.reading_plan(), self.history()
        return {"title": "Briefing", **plan, "observations": past["observations"], "inventory": report.rows_of(inventory.inventory(self.candidates))[0],
                "completeness": past["completeness"], "quality": self.quality(self.recommendations(plan) if plan["recommendations"] else None, history_complete=past["completeness"]["authoritative"])}

    def explain(self, target: str) -> dict[str, object]:
        s = self.history_settings
        bugs = history.bug_overlap(history.keyword_paths(self.commits, self.commit_paths, s, s.bug_keywords), self.churn)
        found = explaining.explain(target, self.sources, self.symbols, self.edges, self.ranking, self.findings, self.omissions, self.churn, bugs)
        matches = found["symbols"].select("path").unionAll(found["ranking"].select("path")).distinct()
        matches = matches if not matches.isEmpty() else self.sources.select("path")
        return {"title": f"Explain {target}", **{k: v if isinstance(v, str) else report.rows_of(v) for k, v in found.items()}, "quality": self.quality(matches=matches)}


def cache_records(spark: SparkSession, path: str | None) -> DataFrame:
    """The records of a cache table; none where there is no table yet."""
    return Snapshots(spark, path, cache.RECORDS).read() if path else spark.createDataFrame([], cache.RECORDS)


def cache_control(spark: SparkSession, path: str, action: str, now: object = None) -> DataFrame | None:
    """status, prune or clear of a cache table at a path, as of ``now`` (None: the wall clock).

    prune and clear commit a new version; a run that adds records meanwhile loses none.
    """
    table = Snapshots(spark, path, cache.RECORDS)
    now = F.current_timestamp() if now is None else F.lit(now)
    if action == "status":
        return cache.totals(table.read())
    if action == "prune":
        table.replace(lambda records: cache.retained(records, now))
        return cache.totals(table.read())
    if action == "clear":
        table.replace(lambda records: records.limit(0))
        return None
    raise ValueError(f"unknown cache action {action!r}")
