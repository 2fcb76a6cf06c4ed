"""Column functions on repository paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names, in lower case, that mark generated and vendored paths.
GENERATED_DIRECTORIES = (
    "target", "dist", "build", "_build", "out", "coverage", "generated", "gen", "obj", "bin", ".gradle", ".next", ".nuxt", ".svelte-kit", ".astro",
    ".turbo", ".vite", ".dart_tool", "tmp",
)
VENDOR_DIRECTORIES = (
    "vendor", "node_modules", ".pnpm-store", ".venv", "venv", "bower_components", "third_party", "third-party", "external", "deps", "vendor_modules", "pods",
)
GENERATED_STEMS = ("generated", "autogenerated", "auto-generated", "codegen", "generated_code")
GENERATED_ENDINGS = (".generated", ".gen", "_pb", ".designer")

# Language by extension; the first language that lists a name wins.
LANGUAGE_EXTENSIONS = {
    "rust": ("rs",), "javascript": ("js", "mjs", "cjs"), "javascript_jsx": ("jsx",), "typescript": ("ts", "mts", "cts"), "typescript_tsx": ("tsx",),
    "python": ("py", "pyi"), "ruby": ("rb", "rake", "gemspec"), "java": ("java",), "c_sharp": ("cs",), "go": ("go",), "lua": ("lua", "rockspec"),
}
LUA_FILENAMES = (".busted", ".luacheckrc")
# Extensions and names that look like source but have no parser.
SOURCE_LIKE_EXTENSIONS = (
    "c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "go", "fs", "fsi", "fsx", "ex", "exs", "erl", "hrl", "lua", "php", "swift", "kt", "kts", "scala",
    "sh", "bash", "zsh", "nu", "zig", "vue", "svelte", "dart", "html", "htm", "css", "scss", "sass", "less", "sql",
)
SOURCE_LIKE_NAMES = ("Dockerfile", "Justfile", "Makefile", "Rakefile")


def in_scope(path: Column, scope: str) -> Column:
    """True for the scope itself and what lies under it; "." takes everything."""
    scope = scope.strip("/")
    return F.lit(True) if scope in ("", ".") else (path == scope) | path.startswith(f"{scope}/")


def scoped_paths(paths: Column, scope: str) -> Column:
    """The paths of an array that are in scope."""
    return F.filter(paths, lambda p: in_scope(p, scope))


def affects_scope(paths: Column, scope: str) -> Column:
    """Whether a commit with these paths is in scope; "." takes commits without paths too."""
    return F.lit(True) if scope in ("", ".") else F.exists(paths, lambda p: in_scope(p, scope))


def git_internal(path: Column) -> Column:
    return in_scope(path, ".git")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column, root: str = ".") -> Column:
    """The directory of a path; ``root`` stands for the repository's own."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(root))


def ancestors(path: Column, itself: bool = False) -> Column:
    """All directories above a path from the top down, "." first, and the path if asked."""
    parts = F.split(path, "/")
    last = F.size(parts) if itself else F.size(parts) - 1
    below = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(below, F.array().cast("array<string>")))


def extension(path: Column) -> Column:
    """The lower-cased extension; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path by extension or file name, or null."""
    by_extension = F.create_map(*(F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, lang)))
    return F.coalesce(F.try_element_at(by_extension, extension(path)), F.when(basename(path).isin(*LUA_FILENAMES), "lua"))


def lua_entry(path: Column, first_line: Column) -> Column:
    """An extensionless script under bin or scripts whose first line calls a Lua interpreter."""
    return path.rlike(r"(^|/)(bin|scripts)/[^/.]+$") & first_line.rlike(r"^#!.*[/\s](lua|luajit|lua[0-9][0-9.]*)(\s|$)")


def source_like(path: Column) -> Column:
    return extension(path).isin(*SOURCE_LIKE_EXTENSIONS) | basename(path).isin(*SOURCE_LIKE_NAMES)


def _found(kind: str, reason: Column) -> Column:
    return F.struct(F.lit(("generated", "vendor", "minified", "source_map").index(kind)).alias("ord"), F.lit(kind).alias("kind"), reason.alias("reason"))


def classify(path: Column) -> Column:
    """Sorted distinct (kind, reason) structs of a path; kinds in declaration order.

    Every component counts, the file name too, up to the first empty one.
    """
    parts = F.split(F.lower(path), "/")
    empty = F.array_position(parts, "")
    used = F.when(empty > 0, F.slice(parts, F.lit(1), F.greatest((empty - 1).cast("int"), F.lit(0)))).otherwise(parts)
    name = F.lower(basename(path))
    stem = F.when(name.rlike(r"[^/]\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    dirs = [
        F.transform(_among(used, names), _named(kind))
        for kind, names in (("generated", GENERATED_DIRECTORIES), ("vendor", VENDOR_DIRECTORIES))
    ]
    is_generated = stem.isin(*GENERATED_STEMS) | reduce(Column.__or__, (stem.endswith(e) for e in GENERATED_ENDINGS))
    names = F.array_compact(F.array(
        F.when(name.endswith(".map"), _found("source_map", F.lit("source_map_filename"))),
        F.when(name.contains(".min.") | stem.endswith(".min"), _found("minified", F.lit("minified_filename"))),
        F.when(is_generated, _found("generated", F.lit("generated_filename"))),
    ))
    found = F.array_sort(F.array_distinct(F.concat(*dirs, names)))
    return F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), c["reason"].alias("reason")))


def _among(parts: Column, names: tuple[str, ...]) -> Column:
    return F.filter(parts, lambda p: p.isin(*names))


def _named(kind: str):
    return lambda p: _found(kind, F.concat(F.lit(f"{kind}_directory:"), p))


def classified_prefix(path: Column) -> Column:
    """The shallowest prefix of a path that is classified by itself, or the path."""
    prefixes = F.slice(ancestors(path, itself=True), F.lit(2), F.size(F.split(path, "/")))
    return F.coalesce(F.try_element_at(F.filter(prefixes, lambda p: F.size(classify(p)) > 0), F.lit(1)), path)


def normalize_focus(value: str) -> str:
    """A focus path as paths are written: forward slashes, no ./ in front, no slash behind."""
    value = value.strip().replace("\\", "/")
    while value.startswith("./"):
        value = value[2:]
    return value.strip("/")


def focus_includes(path: Column, focus_paths: tuple[str, ...]) -> Column:
    """Whether a path is one of the focus paths or under one."""
    wanted = [normalize_focus(f) for f in focus_paths if normalize_focus(f)]
    return reduce(Column.__or__, (in_scope(path, f) for f in wanted), F.lit(False))


def focus_descends(directory: Column, focus_paths: tuple[str, ...]) -> Column:
    """Whether a focus path lies under a directory."""
    wanted = [normalize_focus(f) for f in focus_paths if normalize_focus(f)]
    return reduce(Column.__or__, (F.lit(f).startswith(F.concat(directory, F.lit("/"))) for f in wanted), F.lit(False))


def safety_kind(path: Column) -> Column:
    """Why a path as text is unsafe to use below the repository, or null."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.contains("\0"), "nul")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike(r"^[A-Za-z]:"), "prefix")
        .when(path.contains("\\"), "platform_separator")
        .when(F.array_contains(parts, ".."), "parent")
        .when(F.array_contains(parts, "."), "current")
        .when(F.array_contains(parts, ""), "empty_component")
        .when(path.contains("�"), "non_utf8")
    )


def normalize_relative(path: Column) -> Column:
    """Forward slashes, with "." dropped and ".." resolved; null if it leaves the root."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        up = F.struct((acc["ok"] & (F.size(acc["out"]) > 0)).alias("ok"), F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))).alias("out"))
        down = F.struct(acc["ok"].alias("ok"), F.concat(acc["out"], F.array(p)).alias("out"))
        return F.when(p.isin("", "."), acc).when(p == "..", up).otherwise(down)

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["out"], "/")))


def gitignore_regex(pattern: str) -> str:
    """A gitignore glob as a regular expression on whole paths, for the path or any parent of it."""
    body = pattern.rstrip("/")
    anchored = "/" in body
    body, out, k = body.lstrip("/"), "", 0
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("/**", k) and k + 3 == len(body):
            out, k = out + "/.+", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in body[k + 2 :]:
            end = body.index("]", k + 2)
            inner = body[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and k + 1 < len(body):
            out, k = out + re.escape(body[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    below = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return f"^{'' if anchored else '(?:.*/)?'}{out}{below}$"


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Gitignore semantics over a list of globs: the last that matches decides, ``!`` negates.

    A pattern that ends in a slash takes what is under the directory.
    """
    verdict = F.lit(False)
    for p in patterns:
        if not p.strip():
            raise ValueError("an exclusion pattern is empty")
        if p.startswith("#"):
            continue
        negated = p.startswith("!")
        verdict = F.when(path.rlike(gitignore_regex(p[negated:])), F.lit(not negated)).otherwise(verdict)
    return verdict
