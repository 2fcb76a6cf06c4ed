"""Explicit schemas of the engine's relations (nothing is inferred)."""

from __future__ import annotations

COMMITS = (
    "seq int, id string, parents array<string>, author_name string, author_email string, "
    "author_seconds bigint, committer_seconds bigint, message string"
)
COMMIT_PATHS = "id string, path string"
PATH_COUNTS = "path string, commits bigint, size_bytes bigint, commits_per_kib_milli bigint, size_status string"
CONTRIBUTORS = "name string, email string, commits bigint, share_percent int"
IDENTITIES = "raw_name string, raw_email string, canonical_name string, canonical_email string"
MAILMAP = "proper_name string, proper_email string, commit_name string, commit_email string"
MONTHS = "month string, commits bigint"
CANDIDATES = "path string, state string, symlink boolean"
WORKTREE = "path string, content binary, symlink boolean, ignored boolean"
FILES = "path string, language string, extension string, worktree_state string, status string, limitations array<string>, classifications array<struct<kind:string,reason:string>>"
LOCATION = "struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
SYMBOLS = (
    f"path string, seq int, language string, name string, kind string, role string, scope array<string>, location {LOCATION}, "
    "context string, visibility string, evidence string"
)
FINDINGS = f"kind string, path string, location {LOCATION}, detail string"
EDGES = (
    "source string, target string, symbol string, ambiguous boolean, candidates array<string>, candidate_group string, "
    "resolution_reason string, confidence string, target_visibility string"
)
RANKING = "path string, score bigint, focus_matches int"
LANDMARKS = "kind string, path string, reason string, project_root string, worktree_state string, priority int, focus_matches int"
PROJECT_ROOTS = "path string, kind string, reason string, manifests array<string>, landmark_total bigint, recommendation_total bigint, recommended_paths array<string>"
OMISSIONS = "path string, reason string, detail string, classifications array<struct<kind:string,reason:string>>, overridden boolean"
CACHE_RECORDS = "repository_id string, path string, language string, query_digest string, fingerprint string, created_at timestamp, bytes bigint"
READING_CANDIDATES = "purpose string, path string, project_root string, evidence_kinds array<string>, reason string, limitations array<string>, score bigint, confidence string"

# Labels in declaration order, which is their sort order.
PURPOSES = ("start_here", "architecture", "runtime", "tests", "supporting_context")
EVIDENCE_KINDS = ("landmark", "project_topology", "source_map", "graph", "focus", "history_overlap")
CONFIDENCES = ("high", "medium", "low")
CLASSIFICATION_KINDS = ("generated", "vendor", "minified", "source_map")
WORKTREE_STATES = ("tracked", "modified", "untracked", "unknown")
LANGUAGES = ("rust", "javascript", "javascript_jsx", "typescript", "typescript_tsx", "python", "ruby", "java", "go", "lua", "c_sharp")
SYMBOL_KINDS = (
    "function", "struct", "enum", "trait", "type", "const", "static", "module", "macro", "field", "class", "method", "variable", "interface", "import",
    "export", "identifier", "other",
)
OMISSION_REASONS = (
    "ignored_untracked", "unsupported_language", "non_source", "classified", "explicit_exclusion", "cache_unavailable", "symlink", "unsafe_path",
    "read_error", "traversal_error", "oversized", "binary",
)
LANDMARK_PRIORITIES = {
    "readme": 95, "contributor_instructions": 90, "agent_instructions": 100, "manifest": 85, "lockfile": 80, "workspace_root": 85, "package_root": 85,
    "build_entry_point": 75, "task_entry_point": 75, "test_root": 70, "ci": 65, "ownership": 60, "license": 50, "submodule": 45, "nested_repository": 45,
    "unknown": 0,
}
