"""A worktree as a DataFrame: a listing that follows no link, and bounded reads."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfind.session import share_code
from wayfind.sources.git import _git


def walk(root: str, recursive: bool = False) -> Iterator[tuple[str, bool]]:
    """(path, symlink) of every file below a folder, sorted; links are listed and not followed.

    Folders that are repositories of their own are passed over unless ``recursive``.
    """
    for here, dirs, files in os.walk(root, followlinks=False):
        dirs.sort()
        for name in list(dirs):
            full = os.path.join(here, name)
            nested = os.path.exists(os.path.join(full, ".git")) and not recursive
            if os.path.islink(full):
                yield os.path.relpath(full, root), True
            if name == ".git" or nested or os.path.islink(full):
                dirs.remove(name)
        for name in sorted(files):
            if name != ".git":
                full = os.path.join(here, name)
                yield os.path.relpath(full, root), os.path.islink(full)


def git_folders(root: str) -> list[str]:
    """Paths below a folder that end in .git, but its own, sorted; nothing inside them is listed."""
    out = []
    for here, dirs, files in os.walk(root, followlinks=False):
        if here != root and ".git" in (*dirs, *files):
            out.append(os.path.relpath(os.path.join(here, ".git"), root))
            dirs.clear()
        dirs[:] = [d for d in dirs if d != ".git" and not os.path.islink(os.path.join(here, d))]
    return sorted(out)


def read_bounded(root: str, path: str, most: int) -> bytes | None:
    """Up to one byte more than ``most`` of a file, opened without following links; None if unreadable."""
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        *dirs, name = path.split("/")
        for part in dirs:
            below = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            os.close(at)
            at = below
        with os.fdopen(os.open(name, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=at), "rb") as f:
            return f.read(most + 1)
    except OSError:
        return None
    finally:
        os.close(at)


class Paths(InputPartition):
    def __init__(self, rows: list[tuple[str, bool, bool]]):
        self.rows = rows


class WorktreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.most = options["path"], int(options.get("max_bytes", 1 << 20))
        self.recursive = options.get("recursive") == "true"
        self.content = options.get("content") != "false"

    def partitions(self) -> list[InputPartition]:
        ignored = {x.decode("utf-8", "replace") for x in _git(self.root, "ls-files", "-o", "-i", "--exclude-standard", "-z", check=False).split(b"\0")}
        rows = [(p, link, p in ignored) for p, link in walk(self.root, self.recursive)]
        return [Paths(rows[k : k + 1_000]) for k in range(0, len(rows), 1_000)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path, link, ignored in partition.rows:
            safe = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            yield safe, (read_bounded(self.root, path, self.most) if self.content and not link else None), link, ignored


class Worktree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_worktree"

    def schema(self) -> str:
        return "path string, content binary, symlink boolean, ignored boolean"

    def reader(self, schema) -> DataSourceReader:
        return WorktreeReader(dict(self.options))


def read(spark: SparkSession, repository: str, max_bytes: int = 1 << 20, recursive: bool = False, content: bool = True) -> DataFrame:
    """(path, content, symlink, ignored) of every file; content is at most ``max_bytes`` + 1 bytes."""
    share_code(spark)
    spark.dataSource.register(Worktree)
    flag = lambda x: str(x).lower()
    return spark.read.format("git_worktree").option("max_bytes", max_bytes).option("recursive", flag(recursive)).option("content", flag(content)).load(repository)
