"""Reports from bounded rows: JSON, Markdown, capabilities and the doctor's checks."""

from __future__ import annotations

import json
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions.paths import LANGUAGE_EXTENSIONS
from wayfind.operators.inventory import collection_summary
from wayfind.settings import COMPACT

SCHEMA_VERSION = 1


class TooLarge(ValueError):
    """The rendered report is over its ceiling."""


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def bounded(df: DataFrame, most: int, reason: str = "collection_limit") -> tuple[list[dict], dict]:
    """The first rows of an ordered relation, and what was left out."""
    rows = rows_of(df.limit(most + 1))
    total = len(rows) if len(rows) <= most else df.count()
    return rows[:most], collection_summary(total, min(total, most), reason)


def render_json(report: dict, ceiling: int = COMPACT.rendered_bytes) -> str:
    text = json.dumps({"schema_version": SCHEMA_VERSION, **report}, indent=2, ensure_ascii=False, default=str) + "\n"
    if len(text.encode()) > ceiling:
        raise TooLarge(f"the report has more than {ceiling} bytes")
    return text


def _code(text: object) -> str:
    plain = "".join("�" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in str(text))
    return "`" + plain.replace("`", "'") + "`"


def _cell(value: object) -> str:
    if isinstance(value, list):
        return ", ".join(map(_cell, value))
    if isinstance(value, dict):
        return ", ".join(f"{k} {_cell(v)}" for k, v in value.items())
    return _code(value) if isinstance(value, str) else "" if value is None else str(value)


def render_markdown(report: dict, ceiling: int = COMPACT.rendered_bytes) -> str:
    """The same report as headings and lists."""
    out = [f"# {report.get('title', 'Report')}", ""]
    for name, value in report.items():
        if name == "title":
            continue
        out.append(f"## {name.replace('_', ' ').capitalize()}")
        out.append("")
        if isinstance(value, list):
            out += [f"{k}. " + "; ".join(f"{c}: {_cell(v)}" for c, v in row.items() if v not in (None, [])) if isinstance(row, dict) else f"- {_cell(row)}" for k, row in enumerate(value, 1)] or ["Nothing."]
        elif isinstance(value, dict):
            out += [f"- {k}: {_cell(v)}" for k, v in value.items()] or ["Nothing."]
        else:
            out.append(_cell(value) or "Nothing.")
        out.append("")
    text = "\n".join(out)
    if len(text.encode()) > ceiling:
        raise TooLarge(f"the report has more than {ceiling} bytes")
    return text


def write_json_lines(df: DataFrame, path: str) -> None:
    """A relation of any size as JSON lines, written by the executors."""
    df.write.mode("overwrite").json(path)


def as_json_column(df: DataFrame, into: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(into))


def capabilities(spark: SparkSession) -> DataFrame:
    """(language, extensions, structural): what the parser reads."""
    rows = [(lang, list(exts), True) for lang, exts in LANGUAGE_EXTENSIONS.items()]
    return spark.createDataFrame(rows, "language string, extensions array<string>, structural boolean")


def doctor(spark: SparkSession, repository: str | None = None) -> DataFrame:
    """(ordinal, check, status, detail), in a fixed order."""
    from wayfind.sources import git

    checks = [
        ("python", "pass" if sys.version_info >= (3, 10) else "fail", sys.version.split()[0]),
        ("spark", "pass" if spark.version >= "4" else "warn", spark.version),
        ("time zone", "pass" if spark.conf.get("spark.sql.session.timeZone") == "UTC" else "warn", spark.conf.get("spark.sql.session.timeZone")),
        ("git", "pass" if shutil.which("git") else "fail", shutil.which("git") or "not found"),
    ]
    if repository is not None:
        try:
            top = git.discover(repository)
            checks.append(("repository", "pass", top))
            checks.append(("head", "pass" if git.head(top) else "fail", git.head(top) or "no commit"))
            checks.append(("history", "warn" if git.is_shallow(top) else "pass", "shallow" if git.is_shallow(top) else "complete"))
        except git.RepositoryError as error:
            checks.append(("repository", "fail", str(error)))
    return spark.createDataFrame([(k, *c) for k, c in enumerate(checks, 1)], "ordinal int, check string, status string, detail string")
