"""Which landmark a path is, by its lower-cased base name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind.functions.paths import basename

# File names by landmark.
READMES = ("readme", "readme.md", "readme.rst", "readme.txt")
CONTRIBUTOR_NAMES = ("code_of_conduct.md", "community.md")
AGENT_NAMES = ("agents.md", "claude.md", "codex.md")
MANIFEST_FAMILIES = {
    "rust": ("cargo.toml",),
    "node": ("package.json", "pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "nx.json"),
    "go": ("go.mod", "go.work"),
    "python": ("pyproject.toml", "setup.py", "setup.cfg"),
    "ruby": ("gemfile", "gemspec"),
    "jvm": ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"),
    "other": ("composer.json", "mix.exs"),
}
DOTNET_ENDINGS = (".csproj", ".sln")
LOCKFILES = (
    "cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock", "uv.lock", "gemfile.lock", "go.sum", "composer.lock",
)
BUILD_NAMES = ("build.rs", "makefile", "gnumakefile", "pom.xml", "build.gradle", "build.gradle.kts")
TASK_NAMES = ("justfile", "taskfile.yml", "taskfile.yaml", "rakefile", "procfile")
CI_NAMES = (".gitlab-ci.yml", ".gitlab-ci.yaml", "azure-pipelines.yml", "azure-pipelines.yaml")
CI_COMPONENTS = ("workflows", ".circleci", ".buildkite")
CI_DIRECTORIES = (".github/workflows", ".circleci", ".buildkite")
OWNER_NAMES = ("codeowners", "owners", "maintainers")
LICENSE_STARTS = ("license", "copying", "notice")
TEST_DIRECTORIES = ("test", "tests", "spec", "__tests__")
WORKSPACE_NAMES = ("go.work", "pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "nx.json")
WORKSPACE_MARKERS = {"cargo.toml": "[workspace]", "package.json": '"workspaces"'}


def manifest_family(name: Column) -> Column:
    """The ecosystem of a manifest's name."""
    found = F.when(name.endswith(DOTNET_ENDINGS[0]) | name.endswith(DOTNET_ENDINGS[1]), "dotnet")
    for family, names in MANIFEST_FAMILIES.items():
        found = found.when(name.isin(*names), family)
    return found.otherwise("other")


def is_manifest(name: Column) -> Column:
    every = [n for names in MANIFEST_FAMILIES.values() for n in names]
    return name.isin(*every) | name.endswith(DOTNET_ENDINGS[0]) | name.endswith(DOTNET_ENDINGS[1])


def manifest_role(name: Column, content: Column) -> Column:
    """workspace or package by the name or the text; unknown where the text can't be read."""
    low, marked = F.lower(content), F.lit(False)
    for n, marker in WORKSPACE_MARKERS.items():
        marked = marked | ((name == n) & low.contains(marker))
    return F.when(name.isin(*WORKSPACE_NAMES), "workspace").when(content.isNull(), "unknown").when(marked, "workspace").otherwise("package")


def is_test_directory(name: Column) -> Column:
    return F.lower(name).isin(*TEST_DIRECTORIES)


def is_ci_directory(path: Column) -> Column:
    return F.lower(path).isin(*CI_DIRECTORIES)


def file_landmarks(path: Column) -> Column:
    """The kinds of landmark that a file is, by its path: an array, often empty."""
    name = F.lower(basename(path))
    starts = F.lit(False)
    for s in LICENSE_STARTS:
        starts = starts | name.startswith(s)
    ci = name.isin(*CI_NAMES) | F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, CI_COMPONENTS)))
    tests = {
        "readme": name.isin(*READMES),
        "contributor_instructions": name.startswith("contributing") | name.isin(*CONTRIBUTOR_NAMES),
        "agent_instructions": name.isin(*AGENT_NAMES),
        "manifest": is_manifest(name),
        "lockfile": name.isin(*LOCKFILES),
        "build_entry_point": name.isin(*BUILD_NAMES),
        "task_entry_point": name.isin(*TASK_NAMES),
        "ci": ci,
        "ownership": name.isin(*OWNER_NAMES),
        "license": starts,
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(kind)) for kind, t in tests.items())))
