"""Symbols of source files: one row in, many out.

No grammars are at hand, so declarations are found by patterns on a source whose comments
and strings are blanked, references by scanning its identifiers with the brackets around
them; whether Python parses is asked of its own parser. What this subset cannot see
(overloads, generated names, macros' insides) is not reported; a file with unbalanced
brackets, or that Python refuses, gets a parse_error finding for each misfit and status partial.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.operators.syntax import MAX_DEPTH
from wayfind.schemas import SYMBOLS
from wayfind.session import share_code, spread

CONTEXT_CHARS, NAME_CHARS = 180, 256

_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_C_STRINGS = r'"(?:\\.|[^"\\\n])*"?'
_NAME = r"([A-Za-z_$][\w$]*)"
_WORD, _WORD_START, _WHOLE_WORD = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"[A-Za-z_$]"), re.compile(r"[\w$]+")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|[^\s\w$]")


@dataclass(frozen=True)
class Language:
    """How to blank a language's comments and strings, and the patterns of its declarations."""

    blank: str
    patterns: tuple[tuple[str, str], ...]
    keywords: frozenset[str]
    containers: frozenset[str] = frozenset({"class", "struct", "trait", "interface", "enum", "module", "function", "method"})
    imports: tuple[str, ...] = ()
    types_upper: bool = False
    #: (kind, what encloses a list of declarations as group 1, each of them within it).
    blocks: tuple[tuple[str, str, str], ...] = ()
    _compiled: list = field(default_factory=list, compare=False, repr=False)

    def compiled(self) -> list[tuple[str, re.Pattern]]:
        if not self._compiled:
            self._compiled.extend((kind, re.compile(p, re.MULTILINE)) for kind, p in self.patterns)
        return self._compiled


#: The kind of a reference by its form, in the order call, call of a member, member, type, any other; None: not reported.
REFERENCE_FORMS = ("call", "member_call", "member", "type", "bare")
REFERENCE_KINDS = {
    "rust": ("identifier", "field", "field", "type", "identifier"),
    "javascript": ("identifier", "field", "field", "identifier", "identifier"),
    "typescript": ("identifier", "field", "field", "type", "identifier"),
    "python": ("identifier", "identifier", "identifier", "identifier", "identifier"),
    "ruby": ("identifier", "identifier", "identifier", "type", "identifier"),
    "java": ("method", "method", None, "type", None),
    "c_sharp": ("method", "method", None, "type", None),
    "go": ("function", "method", "field", "type", None),
    "lua": ("function", "function", "field", "identifier", "identifier"),
}

_MODIFIERS = frozenset("public private protected internal static final abstract const readonly override virtual sealed let var void int".split())
_CONTROL = _MODIFIERS | frozenset("if for while switch catch return else do try with in of new function class typeof await yield case import export from as not and or interface enum implements extends".split())
_SCRIPT = Language(
    rf"{_SLASHES}|{_C_STRINGS}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?",
    (
        ("function", rf"\bfunction\s*\*?\s*{_NAME}\s*[(<]"), ("class", rf"\bclass\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("type", rf"\btype\s+{_NAME}\s*[=<]"),
        ("enum", rf"\benum\s+{_NAME}"), ("variable", rf"\b(?:const|let|var)\s+{_NAME}"), ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*{_NAME}\s*\([^)\n]*\)\s*(?::[^{{\n]+)?\{{"),
    ),
    _CONTROL,
    imports=(r"^\s*import\b[^\n;]*", r"\brequire\s*\([^)\n]*\)"),
)

LANGUAGES: dict[str, Language] = {
    "rust": Language(
        rf"{_SLASHES}|{_C_STRINGS}|'(?:\\.|[^'\\\n])'",
        (
            ("function", rf"\bfn\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"), ("trait", rf"\btrait\s+{_NAME}"), ("type", rf"\btype\s+{_NAME}"),
            ("const", rf"\bconst\s+{_NAME}\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?{_NAME}\s*:"), ("module", rf"\bmod\s+{_NAME}"), ("macro", rf"\bmacro_rules!\s*{_NAME}"),
            ("field", rf"^\s+(?:pub(?:\([^)]*\))?\s+)?{_NAME}\s*:\s*[^:=\n]+,\s*$"),
        ),
        frozenset("if for while match loop return fn let pub use mod struct enum trait impl type const static as in ref mut move where unsafe async await dyn crate super self macro_rules u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split()),
        imports=(r"^\s*(?:pub\s+)?use\b[^;]*;",), types_upper=True,
    ),
    "javascript": _SCRIPT, "javascript_jsx": _SCRIPT, "typescript": _SCRIPT, "typescript_tsx": _SCRIPT,
    "python": Language(
        r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
        (("function", rf"^\s*(?:async\s+)?def\s+{_NAME}"), ("class", rf"^\s*class\s+{_NAME}"), ("variable", rf"^[ \t]*{_NAME}[ \t]*(?::[^=\n]+)?=(?!=)[^\n]*[^,\n]$")),
        frozenset("if for while return else elif def class import from as with try except finally lambda not and or in is pass raise yield assert del global nonlocal await async print".split()),
        imports=(r"^\s*(?:from\s+\S+\s+)?import\b[^\n]*",),
    ),
    "ruby": Language(
        r"#[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|^=begin.*?^=end",
        (("method", r"\bdef\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("class", r"\bclass\s+([A-Z]\w*)"), ("module", r"\bmodule\s+([A-Z]\w*)"), ("variable", r"^\s*([a-z_]\w*)\s*=(?![=~>])")),
        frozenset("if unless while until return else elsif end def class module do begin rescue ensure case when then yield self nil true false and or not".split()), types_upper=True,
    ),
    "java": Language(
        rf"{_SLASHES}|{_C_STRINGS}|'(?:\\.|[^'\\\n])*'?",
        (
            ("module", r"^\s*package\s+([\w.]+)"), ("class", rf"\b(?:class|record)\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"),
            ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*[\w<>\[\],.?]+\s+{_NAME}\s*\([^)]*\)\s*(?:throws[^{{;]+)?[{{;]"),
            ("field", rf"^\s+(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w<>\[\],.?]+\s+{_NAME}\s*[=;]"),
        ),
        _CONTROL | frozenset("throw super this synchronized package instanceof".split()), imports=(r"^\s*import\b[^;]*;",), types_upper=True,
    ),
    "c_sharp": Language(
        rf"{_SLASHES}|{_C_STRINGS}|'(?:\\.|[^'\\\n])*'?",
        (
            ("module", r"^\s*namespace\s+([\w.]+)"), ("class", rf"\b(?:class|record)\s+{_NAME}"), ("struct", rf"\bstruct\s+{_NAME}"), ("interface", rf"\binterface\s+{_NAME}"), ("enum", rf"\benum\s+{_NAME}"),
            ("method", rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract|sealed)\s+)+[\w<>\[\],.?]+\s+{_NAME}\s*\([^)]*\)\s*(?:=>|[{{;])"),
            ("field", rf"^\s+(?:(?:public|private|protected|internal|static|readonly|const|virtual|override|required)\s+)+[\w<>\[\],.?]+\s+{_NAME}\s*(?:=|;|\{{\s*(?:get|set|init)\b)"),
        ),
        _CONTROL | frozenset("foreach throw base this lock using namespace is nameof".split()), imports=(r"^\s*using\b[^;(]*;",), types_upper=True,
    ),
    "go": Language(
        rf"{_SLASHES}|{_C_STRINGS}|`[^`]*`?|'(?:\\.|[^'\\\n])*'?",
        (
            ("module", r"^package\s+(\w+)"), ("function", r"^func\s+([A-Za-z_]\w*)"), ("method", r"^func\s*\([^)]*\)\s*([A-Za-z_]\w*)"), ("struct", r"^type\s+([A-Za-z_]\w*)\s+struct\b"), ("interface", r"^type\s+([A-Za-z_]\w*)\s+interface\b"), ("type", r"^type\s+([A-Za-z_]\w*)"),
            ("const", r"^\s*const\s+([A-Za-z_]\w*)"), ("variable", r"^\s*var\s+([A-Za-z_]\w*)"), ("variable", r"\b([A-Za-z_]\w*)[ \t]*(?=(?:,[ \t]*[A-Za-z_]\w*[ \t]*)*:=)"),
        ),
        frozenset("if for switch select return else func go defer range case package import type struct interface map chan var const break continue goto fallthrough default".split()),
        imports=(r'^import\s*\([^)]*\)', r'^import\s+[^\n(]+'), types_upper=True,
        blocks=(
            ("const", r"^\s*const\s*\(([^)]*)\)", r"^\s*([A-Za-z_]\w*)"), ("variable", r"^\s*var\s*\(([^)]*)\)", r"^\s*([A-Za-z_]\w*)"), ("type", r"^type\s*\(([^)]*)\)", r"^\s*([A-Za-z_]\w*)"),
            ("field", r"\bstruct\s*\{([^{}]*)\}", r"^\s*([A-Za-z_]\w*)[ \t]+[^\s(]"), ("method", r"\binterface\s*\{([^{}]*)\}", r"^\s*([A-Za-z_]\w*)\s*\("),
        ),
    ),
    "lua": Language(
        r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
        (
            ("function", r"\bfunction\s+([A-Za-z_]\w*)\s*\("), ("function", r"\bfunction\s+[A-Za-z_]\w*\.([A-Za-z_]\w*)\s*\("), ("method", r"\bfunction\s+[A-Za-z_]\w*:([A-Za-z_]\w*)\s*\("),
            ("function", r"^\s*(?:local\s+)?(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)\s*=\s*function\b"), ("variable", r"^\s*(?:local\s+)?([A-Za-z_]\w*)\s*=(?!=)"),
            ("variable", r"^\s*local\s+(?!function\b)([A-Za-z_]\w*)"), ("field", r"^\s*[A-Za-z_]\w*\.([A-Za-z_]\w*)\s*=(?!=)"),
        ),
        frozenset("if for while return else elseif end function local then do repeat until not and or in nil true false require".split()),
        imports=(r"\blocal\s+[A-Za-z_]\w*\s*=\s*require\s*\(?[^)\n]*\)?",),
    ),
}


@dataclass
class Parsed:
    symbols: list[dict]
    findings: list[dict]
    status: str = "complete"
    cut: bool = False


def _blank(source: str, pattern: str) -> str:
    """The source with comments and strings as spaces, line ends kept."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.DOTALL | re.MULTILINE)


class _Places:
    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def at(self, offset: int) -> dict:
        from bisect import bisect_right

        line = bisect_right(self.starts, offset)
        return {"line": line, "column": offset - self.starts[line - 1] + 1}

    def span(self, start: int, end: int) -> dict:
        return {"start": self.at(start), "end": self.at(end)}


def compact(text: str, most: int = CONTEXT_CHARS) -> str:
    """White space collapsed, cut with an ellipsis."""
    flat = " ".join(text.split())
    return flat if len(flat) <= most else flat[: most - 1] + "…"


def visibility(lang: str, kind: str, name: str, line: str, nested: bool) -> str:
    """What a declaration's modifiers, or in Go its capital, say."""
    start = line.strip()
    if lang == "go" and kind not in ("module", "import"):
        if nested and kind not in ("field", "method"):
            return "internal"
        return "public" if name[:1].isupper() else "internal"
    if lang == "lua":
        return "internal" if start.startswith("local ") else "unknown" if nested else "public"
    low = start.lower()
    if low.startswith(("pub(", "pub ", "public ", "export ")):
        return "public"
    if low.startswith(("private ", "private\t")):
        return "private"
    return "internal" if low.startswith(("protected ", "internal ", "protected\t", "internal\t")) else "unknown"


def _bodies(blanked: str, found: list[tuple[int, int, str, str]], containers: frozenset[str], by_indent: bool) -> list[tuple[int, int, str]]:
    """(start, end, name) of the bodies of containers: braced, or of the deeper lines that follow."""
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", blanked):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    opens = sorted(pairs)
    from bisect import bisect_left

    out = []
    for start, end, kind, name in found if by_indent else ():
        if kind in containers:
            line = blanked.rfind("\n", 0, start) + 1
            indent = len(blanked[line:]) - len(blanked[line:].lstrip(" \t"))
            after = re.compile(rf"^[ \t]{{0,{indent}}}\S", re.MULTILINE).search(blanked, blanked.find("\n", end) + 1 or len(blanked))
            out.append((end, after.start() if after else len(blanked), name))
    for _, end, kind, name in () if by_indent else found:
        k = bisect_left(opens, end)
        if kind in containers and k < len(opens) and not re.search(r"[;}]", blanked[end : opens[k]]):
            out.append((opens[k], pairs[opens[k]], name))
    return out


#: A Go method's receiver and a Lua function's table, up to the name.
_OWNER = {"go": re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*([A-Za-z_]\w*)[^)]*\)\s*$", re.MULTILINE), "lua": re.compile(r"\bfunction\s+([A-Za-z_]\w*)[.:]$")}


def _misfits(blanked: str) -> Iterator[tuple[int, str]]:
    """(place, what) of each bracket that does not fit; reading goes on after it. Nodes over the depth limit are left out."""
    partner, depth, stack = {")": "(", "]": "[", "}": "{"}, 0, []
    for m in re.finditer(r"[()\[\]{}]", blanked):
        if m[0] in "([{":
            depth += 1
            if depth == MAX_DEPTH + 1:
                yield m.start(), f"Syntax deeper than {MAX_DEPTH} levels is left out."
            stack.append((m[0], m.start()))
        elif not stack:
            yield m.start(), f"unexpected {m[0]}"
        else:
            depth -= 1
            opener, at = stack.pop()
            if opener != partner[m[0]]:
                yield at, f"closed otherwise: {opener} {m[0]}"
    for opener, at in stack:
        yield at, f"unclosed {opener}"


def imported_names(lang: str, statement: str) -> list[str]:
    """The names that an import statement binds."""
    if lang == "rust":
        body = re.sub(r"^\s*(?:pub\s+)?use\s+|;$", "", statement.strip())
        parts = re.split(r"[{},]", body)
        last = [re.split(r"\s+as\s+", p.strip())[-1].split("::")[-1].strip() for p in parts]
        return [n for n in last if re.fullmatch(r"\w+", n)]
    if lang == "python":
        tail = re.sub(r"^\s*(?:from\s+\S+\s+)?import\s+", "", statement).strip("() \n")
        bound = [re.split(r"\s+as\s+", p.strip())[-1] for p in tail.split(",") if p.strip() and p.strip() != "*"]
        return [part for name in bound for part in name.split(".")]
    if lang in ("java", "c_sharp"):
        name = re.sub(r"^\s*(?:import|using)\s+(?:static\s+)?|;$", "", statement.strip())
        return [name.split(".")[-1].strip()] if re.fullmatch(r"[\w.]+", name.strip()) else []
    if lang == "go":
        specs = re.finditer(r'(?:([\w.]+)\s+)?["`]([^"`]+)["`]', re.sub(r"^import", "", statement))
        return [name for m in specs for name in (m[1], m[2]) if name and name not in "._"]
    if lang == "lua":
        return re.findall(r"\brequire\s*\(?\s*[\"']([^\"'\n]+)", statement)
    inner = re.search(r"\{([^}]*)\}", statement)
    names = [n for p in inner[1].split(",") if p.strip() for n in re.split(r"\s+as\s+", re.sub(r"^type\s+", "", p.strip()))] if inner else []
    default = re.match(r"\s*import\s+(?:\*\s+as\s+)?([A-Za-z_$][\w$]*)", statement)
    return [*([default[1]] if default and default[1] != "type" else []), *names]


def _references(lang: str, spec: Language, blanked: str, taken: set[int]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, name, kind, evidence) of identifiers that declare nothing.

    Names before a bracket, and all names inside a call's brackets, count as calls, up to the
    nearest block.
    """
    kinds = dict(zip(REFERENCE_FORMS, REFERENCE_KINDS[lang.partition("_js")[0].partition("_ts")[0]], strict=True))
    stack: list[str] = []
    before, declared = "", False
    for m in _TOKEN.finditer(blanked):
        token = m[0]
        if token in "([{":
            stack.append("block" if token == "{" else "call" if token == "(" and _WHOLE_WORD.fullmatch(before) and before not in spec.keywords and not declared else "group")
        elif token in ")]}":
            if stack:
                stack.pop()
        elif _WORD_START.match(token) and token not in spec.keywords and m.start() not in taken:
            after = blanked[m.end() : m.end() + 20].lstrip()
            last_block = max((k for k, s in enumerate(stack) if s == "block"), default=-1)
            member = before == "." or (lang == "lua" and before == ":") or blanked[m.start() - 2 : m.start()] == "::"
            called = after.startswith("(") or (after.startswith("!") and lang == "rust")
            is_type = token[0].isupper() and spec.types_upper
            if lang.startswith(("typescript", "javascript")):
                line = blanked[blanked.rfind("\n", 0, m.start()) + 1 : m.start()]
                is_type = token[0].isupper() and (before in (":", "<", "|", "&", "extends", "implements", "as") or bool(re.search(r"\btype\s+[\w$]+[^=]*=[^;]*$", line)))
                key = before in ("{", ",", ";") and stack[-1:] == ["block"] and after.startswith(":")
                member = member or key or (lang.endswith("x") and after.startswith(("={", '="', "= ")) and bool(re.search(r"<[A-Za-z][^>]*\s$", line)))
            made = called and before == "new"
            form = "type" if is_type and (made or not called) and (lang == "ruby" or not member) and not lang.startswith("javascript") else "member_call" if called and member else "call" if called else "member" if member else "bare"
            kind = kinds[form]
            if lang == "lua" and form == "member_call" and before == ":":
                kind = "method"
            if lang.startswith("typescript") and token == "type" and re.match(r"[A-Za-z_$]", after):
                kind = None  # it opens a declaration
            if kind is not None:
                inside = called or "call" in stack[last_block + 1 :]
                evidence = "type_reference" if kind == "type" else "call" if kind == "method" or inside else "member_reference" if kind == "field" else "bare_reference"
                yield m.start(), m.end(), token, kind, evidence
        before, declared = token, m.start() in taken


def parse(source: str, lang: str, max_symbols: int = 2_048) -> Parsed:
    """The symbols of one file in order of place, at most ``max_symbols``."""
    spec, places = LANGUAGES[lang], _Places(source)
    blanked = _blank(source, spec.blank)
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern in spec.compiled():
        for m in pattern.finditer(blanked):
            if m[1] not in spec.keywords and all(not (a <= m.start(1) < b) for a, b, *_ in found[-1:]):
                found.append((m.start(1), m.end(1), kind, m[1]))
    for kind, enclosing, each in spec.blocks:
        for block in re.finditer(enclosing, blanked, re.MULTILINE):
            for m in re.finditer(each, block[1], re.MULTILINE):
                if m[1] not in spec.keywords:
                    found.append((block.start(1) + m.start(1), block.start(1) + m.end(1), kind, m[1]))
    imports = [(m.start(), m.end(), m[0]) for p in spec.imports for m in re.finditer(p, source, re.MULTILINE) if blanked[m.start() : m.end()].strip()]
    first: dict[int, tuple[int, int, str, str]] = {}
    for row in found:
        if not any(a <= row[0] < b for a, b, _ in imports) or lang == "lua":
            first.setdefault(row[0], row)
    found = sorted(first.values())
    bodies = _bodies(blanked, found, spec.containers, lang in ("python", "ruby", "lua"))
    package = next((name for _, _, kind, name in found if kind == "module"), None) if lang == "go" else None
    lines = source.split("\n")
    rows = []

    def add(start: int, end: int, kind: str, role: str, name: str, context: str, seen: str, evidence: str) -> None:
        scope = [n for a, b, n in bodies if a < start < b]
        if role == "definition":
            owner = _OWNER[lang].search(blanked, blanked.rfind("\n", 0, start) + 1, start) if lang in _OWNER else None
            if owner and owner[1] not in scope:
                scope.append(owner[1])
        if package and scope[:1] != [package]:
            scope.insert(0, package)
        rows.append({"name": name[:NAME_CHARS], "kind": kind, "role": role, "scope": scope, "location": places.span(start, end), "context": context, "visibility": seen, "evidence": evidence})

    for start, end, kind, name in found:
        line = lines[places.at(start)["line"] - 1]
        add(start, end, kind, "definition", name, compact(line), visibility(lang, kind, name, line, any(a < start < b for a, b, _ in bodies)), "declaration")
    taken = {start for start, *_ in found}
    for start, end, statement in imports:
        for name in imported_names(lang, statement):
            at = source.find(name, start, end)
            add(max(at, start), max(at, start) + len(name), "import", "definition", name, compact(statement), "unknown", "import")
        taken |= {m.start() for m in _WORD.finditer(source, start, end)}
    for start, end, name, kind, evidence in _references(lang, spec, blanked, taken):
        add(start, end, kind, "reference", name, compact(lines[places.at(start)["line"] - 1]), "unknown", evidence)
    rows.sort(key=lambda r: (r["location"]["start"]["line"], r["location"]["start"]["column"], r["role"], r["name"]))
    findings, status = [], "complete"
    broken = sorted(_misfits(blanked)) if lang != "ruby" else []
    if lang == "python" and not broken:
        try:
            ast.parse(source)
        except (SyntaxError, ValueError, RecursionError) as error:
            broken = [(places.starts[min(len(places.starts), max(1, getattr(error, "lineno", 1) or 1)) - 1], "the syntax is incomplete here")]
    for at, detail in broken:
        findings.append({"kind": "parse_error", "location": places.span(at, at), "detail": detail})
        status = "partial"
    cut = len(rows) > max_symbols
    if cut:
        status, rows = "partial", rows[:max_symbols]
    return Parsed([{"seq": k, **r} for k, r in enumerate(rows)], findings, status, cut)


_OWN = "seq int, " + SYMBOLS.partition("language string, ")[2]
PAYLOAD = f"struct<symbols array<struct<{_OWN}>>, findings array<struct<kind string, line int, detail string>>, status string, limitations array<string>>"


def query_digest() -> str:
    """A digest of all that decides what is found, so that records of another parser are not used."""
    return hashlib.sha256(repr([(k, v.blank, v.patterns, v.blocks, v.imports, sorted(v.keywords)) for k, v in sorted(LANGUAGES.items())] + [REFERENCE_KINDS]).encode()).hexdigest()


def parse_payloads(files: DataFrame, max_symbols: int = 2_048) -> DataFrame:
    """``files`` (path, language, content and more) with ``payload``, what was found as JSON, in place of the content.

    Files are dealt out first: parsing costs far more than reading, so parts by bytes leave cores idle.
    """
    share_code(files.sparkSession)
    files = spread(files, "path")
    kept = [c for c in files.columns if c != "content"]

    def one(content: object, language: str) -> str:
        source = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
        found = parse(source, language, max_symbols)
        limits = [f"The per-file symbol limit of {max_symbols} was reached."] if found.cut else []
        findings = [{"kind": f["kind"], "line": f["location"]["start"]["line"], "detail": f["detail"]} for f in found.findings]
        return json.dumps({"symbols": found.symbols, "findings": findings, "status": found.status, "limitations": limits})

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[kept].copy()
            made["payload"] = [one(c, lang) for c, lang in zip(batch["content"], batch["language"], strict=True)]
            yield made

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept) + ", payload string"
    return files.select(*kept, "content").mapInPandas(each, schema)


def read_payload(payloads: DataFrame) -> DataFrame:
    """``payloads`` with the column ``parsed``, a struct of symbols, findings, status and limitations."""
    return payloads.withColumn("parsed", F.from_json("payload", PAYLOAD))


def symbols_of(read: DataFrame) -> DataFrame:
    """The symbols of ``read_payload``'s rows, in the symbols' schema."""
    found = read.select("path", "language", F.explode("parsed.symbols").alias("s")).select("path", "language", "s.*")
    return found.select("path", "seq", "language", *(c for c in found.columns if c not in ("path", "seq", "language")))


def findings_of(read: DataFrame) -> DataFrame:
    """(path, kind, line, detail) of what could not be parsed."""
    return read.select("path", F.explode("parsed.findings").alias("f")).select("path", "f.*")


def parse_files(files: DataFrame, max_symbols: int = 2_048) -> DataFrame:
    """Symbols of files (path, language, content), one file at a time, in the symbols' schema."""
    return symbols_of(read_payload(parse_payloads(files.select("path", "language", "content"), max_symbols)))


def parse_findings(files: DataFrame, max_symbols: int = 2_048) -> DataFrame:
    """(path, kind, line, detail) of what could not be parsed."""
    return findings_of(read_payload(parse_payloads(files.select("path", "language", "content"), max_symbols)))
