"""Labels, summaries and the classes of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind.functions.paths import basename

# Which file names explain a path as which landmark.
EXPLAINED = {
    "readme": ("README", "README.md", "README.rst", "README.txt"),
    "instructions": ("AGENTS.md", "CONTRIBUTING.md", "CLAUDE.md"),
    "manifest": ("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml"),
    "lockfile": ("Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock"),
}
MISSING_WORDS = ("missing", "not found", "could not be found", "could not find", "promisor")


def display_label(label: Column) -> Column:
    """A snake-case label as words, the first one capitalised."""
    words = F.replace(label, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def explained_landmark(path: Column) -> Column:
    """What a single path is to a reader, or null; names keep their case here."""
    name = basename(path)
    return (
        F.when(name.isin(*EXPLAINED["readme"]), "readme").when(name.isin(*EXPLAINED["instructions"]), "instructions")
        .when(name.isin(*EXPLAINED["manifest"]) | name.endswith(".csproj"), "manifest").when(name.isin(*EXPLAINED["lockfile"]), "lockfile")
        .when(path.startswith(".github/workflows/") | path.contains("/.github/workflows/"), "ci").when(path.startswith("tests/") | path.contains("/tests/"), "tests")
    )


def actionable_limitation(text: Column) -> Column:
    """Whether a file's limitation means that a resource ran out."""
    return ~text.startswith("The per-file symbol limit") & (text.contains("resource limit") | text.startswith("Syntax traversal reached the depth limit"))


def expected_projection(truncated: Column, reason: Column) -> Column:
    """A list that is cut only for show."""
    return truncated & reason.isin("profile_projection", "output_budget")


def missing_object(message: Column) -> Column:
    """Whether an error says that an object of the repository is not there."""
    low, found = F.lower(message), F.lit(False)
    for word in MISSING_WORDS:
        found = found | low.contains(word)
    return found


def snapshot_state(tracked: Column, modified: Column, untracked: Column) -> Column:
    """The worktree in one word, from its counts; unknown where none were made."""
    return (
        F.when(tracked.isNull(), "unknown").when((modified > 0) & (untracked > 0), "mixed").when(modified > 0, "modified").when(untracked > 0, "untracked").otherwise("clean")
    )


def map_summary(analyzed: Column, omitted: Column, languages: Column) -> Column:
    """One sentence on a source map."""
    return F.format_string("Analyzed %d source files (%s) and recorded %d omitted paths.", analyzed, F.array_join(F.array_sort(F.array_distinct(languages)), ", "), omitted)
