"""Settings and ceilings of an analysis, as plain values that become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default windows in days and keywords.
CHURN_DAYS, RECENT_DAYS = 365, 180
BUG_KEYWORDS = ("fix", "bug", "broken")
FIREFIGHTING_KEYWORDS = ("revert", "hotfix", "emergency", "rollback")


@dataclass(frozen=True)
class Limits:
    """The ceilings of a profile."""

    symbols_per_file: int = 128
    symbols_total: int = 20_000
    edges: int = 2_000
    findings: int = 2_000
    history_items: int = 128
    files: int = 4_096
    file_bytes: int = 1_048_576
    source_bytes: int = 67_108_864
    syntax_depth: int = 2_048
    candidates: int = 32
    commits: int = 100_000
    elapsed_ms: int = 30_000
    rendered_bytes: int = 8_388_608
    landmarks: int = 64
    roots: int = 32


COMPACT = Limits()
EVIDENCE = Limits(
    symbols_per_file=2_048, symbols_total=100_000, edges=20_000, findings=20_000, history_items=2_000, elapsed_ms=120_000, landmarks=4_096, roots=1_024
)

#: What a compact report shows of each collection.
COMPACT_PROJECTION = {
    "files": 32, "symbols_per_file": 16, "symbols": 128, "omissions": 8, "findings": 32, "edges": 32, "ranking": 16, "landmarks": 48, "project_roots": 16,
}


@dataclass(frozen=True)
class MapSettings:
    """What the caller asks of a source map."""

    scope: str = "."
    tokens: int = 1_000
    profile: str = "compact"
    excludes: tuple[str, ...] = ()
    focuses: tuple[str, ...] = ()
    focus_paths: tuple[str, ...] = ()
    cache_mode: str = "auto"
    cache_files: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.tokens <= 0:
            raise ValueError("the token budget must be positive")
        if self.profile not in ("compact", "evidence"):
            raise ValueError(f"unknown profile {self.profile!r}")
        if self.cache_mode not in ("auto", "always", "files", "manual", "no_cache"):
            raise ValueError(f"unknown cache mode {self.cache_mode!r}")
        if self.cache_mode == "files" and not self.cache_files:
            raise ValueError("cache mode files needs at least one path")
        if any(not x.strip() for x in self.excludes):
            raise ValueError("an exclusion pattern is empty")

    @property
    def limits(self) -> Limits:
        return COMPACT if self.profile == "compact" else EVIDENCE

    @property
    def selection_budget(self) -> int:
        """Tokens for snippets: all of them for evidence or tiny budgets, else two thirds, rounded up."""
        return self.tokens if self.profile == "evidence" or self.tokens < 20 else -(-2 * self.tokens // 3)


@dataclass(frozen=True)
class HistorySettings:
    """What the caller asks of a history; ``now`` is given, never the wall clock."""

    now: int
    scope: str = "."
    days: int = CHURN_DAYS
    recent_days: int = RECENT_DAYS
    bug_keywords: tuple[str, ...] = BUG_KEYWORDS
    firefighting_keywords: tuple[str, ...] = FIREFIGHTING_KEYWORDS
    substring: bool = False
    include_emails: bool = False
    limits: Limits = field(default=COMPACT)

    def __post_init__(self) -> None:
        if self.days <= 0 or self.recent_days <= 0:
            raise ValueError("windows must be positive numbers of days")
