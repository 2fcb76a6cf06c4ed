"""The command line: ``python -m wayfind [command] ...``.

Exit codes: 0 done, 2 wrong input, 3 a strict run found issues, 4 unsafe or no repository,
5 the output is too large, 70 an error of the program.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

from wayfind.plans import report
from wayfind.plans.engine import Repository, cache_control
from wayfind.session import local_session
from wayfind.settings import BUG_KEYWORDS, CHURN_DAYS, FIREFIGHTING_KEYWORDS, RECENT_DAYS, HistorySettings, MapSettings
from wayfind.sources.git import RepositoryError, discover, resolve_scope

OK, USAGE, STRICT, UNSAFE, TOO_LARGE, INTERNAL = 0, 2, 3, 4, 5, 70
OPERATIONS = {"churn": ["churn", "churn_sizes"], "contributors": ["contributors_overall", "contributors_recent", "identities"], "bugs": ["bug_commits", "bug_overlap"], "activity": ["activity"], "firefighting": ["firefighting"]}


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wayfind")
    commands = top.add_subparsers(dest="command")

    def add(name: str, path: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--format", choices=("markdown", "json"), default="markdown")
        p.add_argument("--json", action="store_const", const="json", dest="format")
        p.add_argument("--strict", action="store_true")
        p.add_argument("--profile", choices=("compact", "evidence"), default="compact")
        p.add_argument("--now", type=int, default=None, help="reference time in epoch seconds")
        for flag in ("--exclude", "--focus", "--focus-path", "--bug-keyword", "--firefighting-keyword"):
            p.add_argument(flag, action="append", default=[])
        p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
        p.add_argument("--cache-dir", default=None, help="a table of parse records, made where it is not")
        caching = p.add_mutually_exclusive_group()
        caching.add_argument("--cache-mode", choices=("auto", "always", "files", "manual"), default=None)
        caching.add_argument("--no-cache", action="store_const", const="no_cache", dest="cache_mode")
        p.add_argument("--cache-file", action="append", default=[])
        p.add_argument("--tokens", type=int, default=1_000)
        p.add_argument("--days", type=int, default=CHURN_DAYS)
        p.add_argument("--recent-days", type=int, default=RECENT_DAYS)
        p.add_argument("--substring", action="store_true")
        p.add_argument("--include-emails", action="store_true")
        if path:
            p.add_argument("path", nargs="?", default=".")
        return p

    add("briefing")
    add("map")
    add("history", path=False).add_argument("rest", nargs="*", help="[operation] [path]")
    explain = add("explain", path=False)
    explain.add_argument("target")
    explain.add_argument("path", nargs="?", default=".")
    cache = commands.add_parser("cache")
    cache.add_argument("action", choices=("path", "status", "prune", "clear"))
    cache.add_argument("table")
    for name in ("capabilities", "doctor"):
        p = commands.add_parser(name)
        p.add_argument("--format", choices=("markdown", "json"), default="markdown")
        p.add_argument("path", nargs="?", default=None)
    return top


def _repository(a: argparse.Namespace, path: str) -> Repository:
    top = discover(path)
    scope = resolve_scope(top, path)
    maps = MapSettings(scope=scope, tokens=a.tokens, profile=a.profile, excludes=tuple(a.exclude), focuses=tuple(a.focus), focus_paths=tuple(a.focus_path),
                       cache_mode=a.cache_mode or "auto", cache_files=tuple(a.cache_file))
    past = HistorySettings(
        now=a.now if a.now is not None else int(time.time()), scope=scope, days=a.days, recent_days=a.recent_days, bug_keywords=tuple(a.bug_keyword) or BUG_KEYWORDS,
        firefighting_keywords=tuple(a.firefighting_keyword) or FIREFIGHTING_KEYWORDS, substring=a.substring, include_emails=a.include_emails, limits=maps.limits,
    )
    return Repository(local_session(), top, maps, past, a.cache_dir)


def run(args: list[str]) -> tuple[int, str]:
    """(exit code, text) of a command line."""
    try:
        a = arguments().parse_args(args if args and not os.path.isdir(args[0]) else ["briefing", *args])
    except SystemExit as error:
        return (OK if error.code == 0 else USAGE), ""
    try:
        if a.command == "cache":
            if a.action == "path":
                return OK, a.table + "\n"
            done = cache_control(local_session(), a.table, a.action)
            return OK, report.render_json({"title": f"Cache {a.action}", "repositories": report.rows_of(done) if done is not None else []})
        if a.command in ("capabilities", "doctor"):
            spark = local_session()
            rows = report.rows_of(report.capabilities(spark) if a.command == "capabilities" else report.doctor(spark, a.path))
            made = {"title": a.command.capitalize(), a.command: rows}
        elif a.command == "history":
            named = a.rest[0] if a.rest and a.rest[0] in OPERATIONS else None
            path = next(iter(a.rest[1:] if named else a.rest), ".")
            made = _repository(a, path).history()
            if named:
                made = {k: v for k, v in made.items() if k in ("title", "counts", "completeness", *OPERATIONS[named])}
        else:
            repository = _repository(a, a.path)
            if a.command == "explain":
                if not a.target.strip():
                    raise ValueError("the target is empty")
                made = repository.explain(a.target)
            else:
                made = repository.map() if a.command == "map" else repository.briefing()
        text = report.render_json(made) if a.format == "json" else report.render_markdown(made)
        if a.format == "markdown" and getattr(a, "color", "never") != "never" and (a.color == "always" or sys.stdout.isatty()):
            text = re.sub(r"^(#+ .*)$", "\x1b[1m\\1\x1b[0m", text, flags=re.MULTILINE)
    except RepositoryError as error:
        return UNSAFE, f"{error}\n"
    except report.TooLarge as error:
        return TOO_LARGE, f"{error}\n"
    except ValueError as error:
        return USAGE, f"{error}\n"
    strict = getattr(a, "strict", False)
    issues = strict and (not made.get("completeness", {"authoritative": True})["authoritative"] or made.get("shortfall") or made.get("quality", {}).get("issues"))
    return (STRICT if issues else OK), text


def main() -> None:
    code, text = run(sys.argv[1:])
    try:
        (sys.stdout if code in (OK, STRICT) else sys.stderr).write(text)
        sys.stdout.flush()
    except BrokenPipeError:  # the reader has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    sys.exit(code)
