"""Git repositories as DataFrames, through Python data sources.

``git_commits``, ``git_tree``, ``git_index`` and ``git_paths`` read a repository in a folder
that executors can read. The repository's own configuration, hooks and filters are not
run: objects are read by plumbing commands with an empty configuration. ``git_paths`` is
partitioned over commits, so diffs of a long history are made in parallel.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfind.session import share_code

MAX_CHANGED_PATHS = 10_000
COMMITS_PER_PARTITION = 500
EMPTY_TREES = {40: "4b825dc642cb6eb9a060e54bf8d69288fbee4904", 64: "6ef19b41225c5369f1c104d45d8d85efa9b057b53b14b4b9b939dd74decc5321"}


class RepositoryError(ValueError):
    """The folder is no repository, or the scope is not inside it."""


def _environment() -> dict[str, str]:
    return {"PATH": os.environ.get("PATH", ""), "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C", "GIT_NO_REPLACE_OBJECTS": "1"}


def _command(repository: str, *args: str) -> list[str]:
    safe = ["-c", f"safe.directory={repository}", "-c", "core.fsmonitor=false", "-c", "core.hooksPath=/dev/null", "-c", "diff.external=", "-c", "core.quotePath=false"]
    return ["git", *safe, "-C", repository, *args]


def _git(repository: str, *args: str, check: bool = True) -> bytes:
    done = subprocess.run(_command(repository, *args), capture_output=True, env=_environment(), check=False)
    if check and done.returncode:
        raise RepositoryError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout


def discover(path: str) -> str:
    """The top folder of the repository that encloses a path."""
    start = path if os.path.isdir(path) else os.path.dirname(path) or "."
    return os.path.realpath(_git(start, "rev-parse", "--show-toplevel").decode().rstrip("\n"))


def resolve_scope(repository: str, path: str) -> str:
    """A folder inside the repository as a relative scope, "." for its top; no link may be on the way."""
    top, here = os.path.realpath(repository), os.path.abspath(path)
    relative = os.path.relpath(here, top)
    if relative == ".":
        return "."
    if relative.startswith(".."):
        here = os.path.realpath(path)
        relative = os.path.relpath(here, top)
        if relative.startswith(".."):
            raise RepositoryError(f"{path} is outside the repository")
    at = top
    for part in relative.split("/"):
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise RepositoryError(f"{relative} leads through a link")
    if not os.path.isdir(at):
        raise RepositoryError(f"{relative} is no directory")
    return relative


def head(repository: str) -> str | None:
    found = _git(repository, "rev-parse", "--verify", "-q", "HEAD", check=False).decode().strip()
    return found or None


def is_shallow(repository: str) -> bool:
    return _git(repository, "rev-parse", "--is-shallow-repository", check=False).decode().strip() == "true"


def missing_objects(repository: str) -> int:
    """Objects of HEAD that a partial clone has not fetched; any other clone has them all."""
    if not _git(repository, "config", "--get-regexp", r"^remote\..*\.promisor$", check=False).strip():
        return 0
    listed = _git(repository, "rev-list", "--objects", "--missing=print", "HEAD", check=False)
    return sum(line.startswith(b"?") for line in listed.splitlines())


def committed_mailmap(repository: str) -> list[tuple[str | None, str | None, str | None, str | None]]:
    """(proper_name, proper_email, commit_name, commit_email) entries of .mailmap at HEAD."""
    text = _git(repository, "cat-file", "blob", "HEAD:.mailmap", check=False).decode("utf-8", "replace")
    return [entry for line in text.splitlines() if (entry := mailmap_entry(line))]


def mailmap_entry(line: str) -> tuple[str | None, str | None, str | None, str | None] | None:
    """One line of a mailmap in any of its four forms, or None."""
    found = re.match(r"^([^<#]*)<([^>]*)>\s*(?:([^<#]*)<([^>]*)>)?", line.strip())
    if not found:
        return None
    name, email, other_name, other_email = ((x or "").strip() or None for x in found.groups())
    return (name, None, None, email) if other_email is None else (name, email, other_name, other_email)


def _record(record: bytes) -> tuple[str, str, str]:
    """(mode, oid, path) of a line of ls-tree."""
    meta, _, path = record.partition(b"\t")
    mode, _, oid = meta.decode().split()
    return mode, oid, path.decode("utf-8", "replace")


def objects(repository: str, oids: Iterable[str]) -> Iterator[tuple[str, bytes | None]]:
    """(kind, content) of objects in order, by one process for all of them; ("missing", None) for one that is not there."""
    oids = iter(oids)
    if (oid := next(oids, None)) is None:
        return
    git = subprocess.Popen(_command(repository, "cat-file", "--batch"), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=_environment() | {"GIT_NO_LAZY_FETCH": "1"})
    try:
        while oid is not None:
            git.stdin.write(f"{oid}\n".encode())
            git.stdin.flush()
            said = git.stdout.readline().split()
            if len(said) == 3:
                yield said[1].decode(), git.stdout.read(int(said[2]) + 1)[:-1]
            elif said[-1:] == [b"missing"]:
                yield "missing", None
            else:
                raise RepositoryError(f"object {oid} cannot be read")
            oid = next(oids, None)
    finally:
        git.stdin.close()
        git.stdout.close()
        git.wait()


def tree_entries(content: bytes, oid_bytes: int) -> Iterator[tuple[str, str, str]]:
    """(name, mode, oid) of each entry of a tree object."""
    at = 0
    while at < len(content):
        space, end = content.index(b" ", at), content.index(b"\0", at)
        mode, name = content[at:space].decode().zfill(6), content[space + 1 : end].decode("utf-8", "replace")
        at = end + 1 + oid_bytes
        yield name, mode, content[end + 1 : at].hex()


def tree_lookup(repository: str) -> Callable[[DataFrame], DataFrame]:
    """The entries (tree, name, mode, oid) of trees by id, for ``operators.trees``: one process for each partition of ids."""

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, rows = batch.column(0).to_pylist(), []
            for tree, (kind, content) in zip(wanted, objects(repository, wanted), strict=True):
                if kind == "tree":
                    rows += [(tree, *e) for e in tree_entries(content, len(tree) // 2)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["tree", "name", "mode", "oid"])

    def lookup(wanted: DataFrame) -> DataFrame:
        share_code(wanted.sparkSession)
        return wanted.select("tree").mapInArrow(entries, "tree string, name string, mode string, oid string")

    return lookup


def commit_count(repository: str) -> int:
    """Commits that HEAD reaches, whatever ceiling a reader has."""
    return int(_git(repository, "rev-list", "--count", "HEAD")) if head(repository) else 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        raise NotImplementedError


class _Source(DataSource):
    reads: type[_Reader]
    columns: str

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return self.reads(dict(self.options))


class CommitReader(_Reader):
    """All commits that HEAD reaches, newest committer time first, numbered from 0."""

    FORMAT = "%H%x00%P%x00%an%x00%ae%x00%at%x00%ct%x00%B%x00%x01%x00"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        limit = ["-n", self.options["max_commits"]] if "max_commits" in self.options else []
        raw = _git(self.path, "log", "--date-order", *limit, f"--format={self.FORMAT}", "HEAD") if head(self.path) else b""
        for seq, record in enumerate(raw.split(b"\x00\x01\x00\n")[:-1]):
            oid, parents, name, email, author, committer, message = (x.decode("utf-8", "replace") for x in record.split(b"\0"))
            yield seq, oid, parents.split(), name, email, int(author), int(committer), message.rstrip("\n")


class GitCommits(_Source):
    reads, columns = CommitReader, "seq int, id string, parents array<string>, author_name string, author_email string, author_seconds bigint, committer_seconds bigint, message string"

    @classmethod
    def name(cls) -> str:
        return "git_commits"


class TreeReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tree = self.options.get("tree", "HEAD")
        if tree == "HEAD" and not head(self.path):
            return
        listed = [_record(r) for r in _git(self.path, "ls-tree", "-r", "-z", "--full-tree", tree).split(b"\0") if r]
        wanted = (oid for mode, oid, _ in listed if mode != "160000") if self.options.get("content") == "true" else ()
        contents = objects(self.path, wanted)
        for mode, oid, path in listed:
            yield path, mode, oid, (next(contents)[1] if self.options.get("content") == "true" and mode != "160000" else None)


class GitTree(_Source):
    """Blobs and submodules (mode 160000) of a tree; ``content`` reads the blobs too."""

    reads, columns = TreeReader, "path string, mode string, oid string, content binary"

    @classmethod
    def name(cls) -> str:
        return "git_tree"


class IndexReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        listed = []
        for record in filter(None, _git(self.path, "ls-files", "-s", "-z").split(b"\0")):
            meta, _, path = record.partition(b"\t")
            listed.append((*meta.decode().split(), path.decode("utf-8", "replace")))
        content = self.options.get("content") == "true"
        contents = objects(self.path, (oid for mode, oid, *_ in listed if mode != "160000") if content else ())
        for mode, oid, stage, path in listed:
            yield path, mode, oid, int(stage), (next(contents)[1] if content and mode != "160000" else None)


class GitIndex(_Source):
    reads, columns = IndexReader, "path string, mode string, oid string, stage int, content binary"

    @classmethod
    def name(cls) -> str:
        return "git_index"


class CommitRange(InputPartition):
    def __init__(self, ids: list[tuple[str, str | None]]):
        self.ids = ids


class PathReader(_Reader):
    """Paths that each non-merge commit changed against its first parent, renames not followed.

    A commit shows ``MAX_CHANGED_PATHS`` at most; one more row without a path has the number that it
    ``lost`` to that, or -1 where its trees cannot be read.
    """

    def partitions(self) -> list[InputPartition]:
        raw = _git(self.path, "rev-list", "--parents", "HEAD").decode().split("\n") if head(self.path) else []
        ids = [(x[0], x[1] if len(x) > 1 else None) for line in raw if (x := line.split()) and len(x) < 3]
        return [CommitRange(ids[k : k + COMMITS_PER_PARTITION]) for k in range(0, len(ids), COMMITS_PER_PARTITION)] or [CommitRange([])]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        for oid, parent in partition.ids:
            try:
                raw = _git(self.path, "diff-tree", "-r", "-z", "--no-renames", "--name-only", parent or EMPTY_TREES[len(oid)], oid)
            except RepositoryError:
                yield oid, None, -1
                continue
            paths = [x for x in raw.split(b"\0") if x]
            for path in paths[:MAX_CHANGED_PATHS]:
                yield oid, path.decode("utf-8", "replace"), 0
            if len(paths) > MAX_CHANGED_PATHS:
                yield oid, None, len(paths) - MAX_CHANGED_PATHS


class GitPaths(_Source):
    reads, columns = PathReader, "id string, path string, lost bigint"

    @classmethod
    def name(cls) -> str:
        return "git_paths"


def register(spark: SparkSession) -> None:
    share_code(spark)
    for source in (GitCommits, GitTree, GitIndex, GitPaths):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, repository: str, **options: object) -> DataFrame:
    """One of the four sources over a repository."""
    register(spark)
    reader = spark.read.format(kind)
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load(repository)
