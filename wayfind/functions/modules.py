"""Column functions on imports, modules and graph weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names too common to be dependencies, kinds that graphs define, weights.
GENERIC_NAMES = ("data", "default", "error", "item", "key", "main", "new", "result", "self", "value")
GRAPH_KINDS = ("function", "struct", "enum", "trait", "type", "const", "static", "module", "macro", "class", "method", "interface")
MODULE_ENDINGS = ("/__init__", "/mod", ".js", ".ts", ".tsx", ".py", ".rb", ".rs", ".java", ".cs", ".go", ".lua", ".rockspec")
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": 0.25}
VISIBILITY_WEIGHTS = {"public": 1.0, "internal": 0.8, "private": 0.35, "unknown": 0.7}


def graph_definition(role: Column, kind: Column) -> Column:
    return (role == "definition") & kind.isin(*GRAPH_KINDS)


def generic_name(name: Column) -> Column:
    return F.lower(name).isin(*GENERIC_NAMES)


def graph_reference(role: Column, evidence: Column, kind: Column, name: Column) -> Column:
    return (role == "reference") & ~evidence.isin("bare_reference", "member_reference") & (kind != "field") & ~generic_name(name)


def _strip(value: Column, ending: str) -> Column:
    return F.regexp_replace(value, f"(?:{ending.replace('.', chr(92) + '.')})+$", "")


def normalize_hint(value: Column) -> Column:
    """A module as written to the path it may mean; the order of the steps matters."""
    value = F.regexp_replace(value, r"""^["'`;,]+|["'`;,]+$""", "")
    value = F.regexp_replace(F.regexp_replace(value, r"^(?:\./)+", ""), r"^(?:\.\./)+", "")
    value = reduce(_strip, MODULE_ENDINGS, F.translate(value, "\\", "/"))
    value = F.regexp_replace(F.replace(value, F.lit("::"), F.lit("/")), "^/+|/+$", "")
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def import_hints(context: Column, lang: Column) -> Column:
    """Sorted distinct modules that an import statement may mean.

    They are the first quoted string (in Lua also with slashes for dots), the word after
    ``from``, and every part with ``::`` or a slash.
    """
    double, single = F.regexp_extract(context, '"([^"]*)"', 1), F.regexp_extract(context, "'([^']*)'", 1)
    quoted = normalize_hint(F.when(context.rlike('"[^"]*"'), double).otherwise(single))
    words = F.split(F.trim(F.regexp_replace(context, r"\s+", " ")), " ")
    after = F.array_position(words, "from")
    module = F.when(after > 0, normalize_hint(F.try_element_at(words, (after + 1).cast("int"))))
    parts = F.filter(F.split(context, r"[\s;,()]"), lambda p: p.contains("::") | p.contains("/"))
    some = F.array(quoted, F.when((lang == "lua") & quoted.contains("."), F.translate(quoted, ".", "/")), module)
    every = F.concat(some, F.transform(parts, normalize_hint))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(every), lambda h: h != "")))


def _endings(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def path_keys(path: Column) -> Column:
    """What a file's path can be named by: (kind, key) for its endings and its directory's.

    With ``hint_keys`` it turns the test whether a hint means a path into an equality. The
    normal form is bound to a variable, as it is used for every ending.
    """
    key = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))

    def keys(own: Column) -> Column:
        above = F.regexp_extract(own, "^(.*)/[^/]*$", 1)
        return F.concat(F.transform(_endings(own), key("path")), F.transform(_endings(above), key("directory")))

    return F.flatten(F.transform(F.array(normalize_hint(path)), keys))


def hint_keys(hint: Column) -> Column:
    """The keys of a hint: itself, its module without crate, self or super, and its last name as a directory."""
    module = F.when(hint.contains("/"), F.regexp_replace(hint, "/[^/]*$", "")).otherwise(hint)
    for prefix in ("crate/", "self/", "super/"):
        module = F.regexp_replace(module, f"^(?:{prefix})+", "")
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    return F.array_distinct(F.array(key("path", hint), key("path", module), key("directory", F.element_at(F.split(hint, "/"), -1))))


def module_path_matches(path: Column, hints: Column) -> Column:
    """Whether any of the hints can mean the path."""
    return F.arrays_overlap(path_keys(path), F.flatten(F.transform(hints, hint_keys)))


def lexical_weight(symbol: Column) -> Column:
    return F.when(generic_name(symbol) | symbol.startswith("_"), 0.25).otherwise(1.0)


def _weights(value: Column, table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def edge_weight(symbol: Column, confidence: Column, visibility: Column) -> Column:
    return lexical_weight(symbol) * _weights(confidence, CONFIDENCE_WEIGHTS) * _weights(visibility, VISIBILITY_WEIGHTS)


def qualified(scope: Column, name: Column) -> Column:
    return F.array_join(F.concat(scope, F.array(name)), "::")
