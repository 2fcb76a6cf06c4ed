"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.functions import labels as N
from wayfind.functions import landmarks as L
from wayfind.functions import modules as M
from wayfind.functions import paths as P
from wayfind.functions import text as X
from wayfind.session import table
from wayfind.suite import fixed as W
from wayfind.suite.adapters import COMMITS_SQL, NOW, PAGE_PATHS_SQL, commits, page_paths

WITH = f"with {PAGE_PATHS_SQL}"
_KINDS = [("generated", W.GENERATED), ("vendor", W.VENDOR)]
_NAME = "lower(regexp_extract(path, '([^/]*)$', 1))"
_STEM = f"regexp_replace({_NAME}, '(.)[.][^.]*$', '\\1')"


def _in(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


_CLASSES = " union all ".join(
    f"select page_id, path, {k} as ord, '{kind}' as kind, '{kind}_directory:' || part as reason from (select page_id, path, unnest(string_split(lower(path), '/')) as part from paths) where part in {_in(names)}"
    for k, (kind, names) in enumerate(_KINDS)
) + f""" union all select page_id, path, 3, 'source_map', 'source_map_filename' from paths where ends_with({_NAME}, '.map')
 union all select page_id, path, 2, 'minified', 'minified_filename' from paths where contains({_NAME}, '.min.') or ends_with({_STEM}, '.min')
 union all select page_id, path, 0, 'generated', 'generated_filename' from paths where {_STEM} in {_in(W.GENERATED_STEMS)} or {' or '.join(f"ends_with({_STEM}, '{e}')" for e in W.GENERATED_ENDINGS)}"""


@register("classify_path", f"{WITH}, c as (select distinct * from ({_CLASSES})) select p.page_id, coalesce(string_agg(kind || '=' || reason, ';' order by ord, reason), '') as classes from paths p left join c using (page_id) group by p.page_id")
def classify_path(spark, d):
    joined = F.array_join(F.transform(P.classify(F.col("path")), lambda c: F.concat_ws("=", c["kind"], c["reason"])), ";")
    return page_paths(spark, d).select("page_id", joined.alias("classes"))


@register("classification_summary", f"""{WITH}, c as (select distinct path, kind from ({_CLASSES})) select count(distinct path)::bigint as paths, count(*) filter (kind = 'generated')::bigint as generated,
  count(*) filter (kind = 'vendor')::bigint as vendor, count(*) filter (kind = 'minified')::bigint as minified, count(*) filter (kind = 'source_map')::bigint as source_map from c""")
def classification_summary(spark, d):
    from wayfind.operators.inventory import classification_summary as summary

    return summary(page_paths(spark, d).select("path"))


@register("classified_prefix", f"""{WITH}, parts as (select page_id, path, generate_subscripts(string_split(path, '/'), 1) as n, unnest(string_split(lower(path), '/')) as part from paths),
  hit as (select page_id, min(n) as n from parts where part in {_in(W.GENERATED + W.VENDOR)} or ends_with(part, '.map') or contains(part, '.min.')
    or regexp_replace(part, '(.)[.][^.]*$', '\\1') in {_in(W.GENERATED_STEMS)} or regexp_matches(regexp_replace(part, '(.)[.][^.]*$', '\\1'), '([.]generated|[.]gen|_pb|[.]designer|[.]min)$') group by page_id)
  select page_id, case when n is null then path else array_to_string(string_split(path, '/')[1:n], '/') end as prefix from paths left join hit using (page_id)""")
def classified_prefix(spark, d):
    return page_paths(spark, d).select("page_id", P.classified_prefix(F.col("path")).alias("prefix"))


@register("path_parts", f"""{WITH} select page_id, regexp_extract(path, '([^/]*)$', 1) as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as parent,
  lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) as ext, len(string_split(path, '/'))::bigint as n_ancestors from paths""")
def path_parts(spark, d):
    p = F.col("path")
    return page_paths(spark, d).select("page_id", P.basename(p).alias("base"), P.parent(p).alias("parent"), P.extension(p).alias("ext"), F.size(P.ancestors(p)).cast("long").alias("n_ancestors"))


_EXT = "lower(regexp_extract(path, '[^/][.]([^./]+)$', 1))"


@register("language_of_path", f"{WITH} select page_id, case " + " ".join(f"when {_EXT} in {_in(e.split())} then '{lang}'" for lang, e in W.EXTENSIONS.items()) + f" end as language, {_EXT} in {_in(P.SOURCE_LIKE_EXTENSIONS)} or regexp_extract(path, '([^/]*)$', 1) in {_in(P.SOURCE_LIKE_NAMES)} as source_like from paths")
def language_of_path(spark, d):
    p = F.col("path")
    return page_paths(spark, d).select("page_id", P.language(p).alias("language"), P.source_like(p).alias("source_like"))


@register("lua_entries", "select doc_id, doc_id % 3 = 1 and doc_id % 4 < 2 as lua_entry from documents")
def lua_entries(spark, d):
    """Extensionless scripts whose first line names a Lua interpreter, among made-up paths and lines."""
    path = F.concat(F.when(F.col("doc_id") % 3 == 1, "tools/bin/run").when(F.col("doc_id") % 3 == 2, "bin/run.sh").otherwise("src/run"), F.col("doc_id").cast("string"))
    line = F.element_at(F.array(*map(F.lit, ("#!/usr/bin/env lua", "#!/usr/bin/lua5.4 -W", "#!/bin/sh", "lua"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", P.lua_entry(path, line).alias("lua_entry"))


@register("in_scope", f"{WITH} select page_id, path = 'tionsh.example.net' or starts_with(path, 'tionsh.example.net/') as inside, path = '.git' or starts_with(path, '.git/') as internal from paths")
def in_scope(spark, d):
    p = F.col("path")
    return page_paths(spark, d).select("page_id", P.in_scope(p, "tionsh.example.net/").alias("inside"), P.git_internal(p).alias("internal"))


PATTERNS = ("*.js", "!Lib.min.js", "/tionsh.example.net/en/", "tests/", "**/src/*.rs", "lib/*.lua")


@register("excluded", rf"""{WITH} select page_id, case when regexp_matches(path, '^(.*/)?src/[^/]*\.rs(/.*)?$') then true
  when regexp_matches(path, '^(.*/)?tests/.*$') then true when regexp_matches(path, '^tionsh\.example\.net/en/.*$') then true when regexp_matches(path, '^lib/[^/]*\.lua(/.*)?$') then true
  when regexp_matches(path, '^(.*/)?Lib\.min\.js(/.*)?$') then false when regexp_matches(path, '^(.*/)?[^/]*\.js(/.*)?$') then true else false end as excluded from paths""")
def excluded(spark, d):
    return page_paths(spark, d).select("page_id", P.excluded(F.col("path"), PATTERNS).alias("excluded"))


@register("focus_paths", f"""{WITH} select page_id, path = 'tionsh.example.net/en' or starts_with(path, 'tionsh.example.net/en/') or path = 'ththon.example.com' or starts_with(path, 'ththon.example.com/') as focused,
  starts_with('tionsh.example.net/en', regexp_replace(path, '/.*$', '') || '/') or starts_with('ththon.example.com', regexp_replace(path, '/.*$', '') || '/') as leads from paths""")
def focus_paths(spark, d):
    focus, top = ("./tionsh.example.net\\en/", "ththon.example.com"), F.regexp_replace("path", "/.*$", "")
    return page_paths(spark, d).select("page_id", P.focus_includes(F.col("path"), focus).alias("focused"), P.focus_descends(top, focus).alias("leads"))


_UNSAFE = "case page_id % 9 when 0 then '/' || path when 1 then 'a/../' || path when 2 then './' || path when 3 then 'a//' || path when 4 then 'a\\' || path when 5 then 'C:' || path when 6 then '' else path end"


@register("path_safety", f"""{WITH}, u as (select page_id, {_UNSAFE} as p from paths) select page_id, case when p = '' then 'empty' when starts_with(p, '/') then 'absolute' when regexp_matches(p, '^[A-Za-z]:') then 'prefix'
  when contains(p, '\\') then 'platform_separator' when list_contains(string_split(p, '/'), '..') then 'parent' when list_contains(string_split(p, '/'), '.') then 'current' when list_contains(string_split(p, '/'), '') then 'empty_component' end as safety from u""")
def path_safety(spark, d):
    p, k = F.col("path"), F.col("page_id") % 9
    made = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.concat(F.lit("a/../"), p)).when(k == 2, F.concat(F.lit("./"), p)).when(k == 3, F.concat(F.lit("a//"), p))
    made = made.when(k == 4, F.concat(F.lit("a\\"), p)).when(k == 5, F.concat(F.lit("C:"), p)).when(k == 6, F.lit("")).otherwise(p)
    return page_paths(spark, d).select("page_id", P.safety_kind(made).alias("safety"))


@register("normalize_path", f"{WITH} select page_id, case page_id % 3 when 0 then path when 1 then 'b/' || path else null end as normal from paths")
def normalize_path(spark, d):
    p, k = F.col("path"), F.col("page_id") % 3
    made = F.when(k == 0, F.concat(F.lit("./x/..\\"), p)).when(k == 1, F.concat(F.lit("a/../b//./"), p)).otherwise(F.concat(F.lit("a/../../"), p))
    return page_paths(spark, d).select("page_id", P.normalize_relative(made).alias("normal"))


_LANDMARK_SQL = {
    "readme": f"{_NAME} in {_in(W.READMES)}", "contributor_instructions": f"(starts_with({_NAME}, 'contributing') or {_NAME} in {_in(W.CONTRIBUTORS)})",
    "agent_instructions": f"{_NAME} in {_in(W.AGENTS)}",
    "manifest": f"({_NAME} in {_in(W.MANIFESTS)} or ends_with({_NAME}, '.csproj') or ends_with({_NAME}, '.sln'))",
    "lockfile": f"{_NAME} in {_in(W.LOCKFILES)}", "build_entry_point": f"{_NAME} in {_in(W.BUILDS)}", "task_entry_point": f"{_NAME} in {_in(W.TASKS)}",
    "ci": f"({_NAME} in {_in(W.CI)} or list_has_any(string_split(lower(path), '/'), ['workflows', '.circleci', '.buildkite']))", "ownership": f"{_NAME} in {_in(W.OWNERS)}",
    "license": "(" + " or ".join(f"starts_with({_NAME}, '{s}')" for s in W.LICENSES) + ")",
}


@register("file_landmarks", f"{WITH} select page_id, concat_ws(',', {', '.join(f'case when {t} then {chr(39)}{k}{chr(39)} end' for k, t in _LANDMARK_SQL.items())}) as kinds from paths")
def file_landmarks(spark, d):
    return page_paths(spark, d).select("page_id", F.array_join(L.file_landmarks(F.col("path")), ",").alias("kinds"))


# --- texts --------------------------------------------------------------------------------


@register("token_estimate", "select doc_id, greatest(1, ceil(length(text) / 4.0))::bigint as tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@register("digests", "select doc_id, sha256(source || chr(0) || lang || chr(0) || text) as digest, case length(sha256(text)) when 64 then 'sha256' end as format from documents")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", X.digest(F.array("source", "lang", "text")).alias("digest"), X.object_format(F.sha2("text", 256)).alias("format"))


@register("escapes", r"""select doc_id, regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', chr(65533), 'g'), '([\\`*_{}\[\]()#+\-.!|<>])', '\\\1', 'g') as markdown,
  replace(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', chr(65533), 'g'), '`', '''') as code from documents""")
def escapes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.escape_markdown(t).alias("markdown"), X.escape_inline_code(t).alias("code"))


@register("bounded_text", "select doc_id, case when length(c) > 180 then substr(c, 1, 179) || '…' else c end as context from (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) as c from documents)")
def bounded_text(spark, d):
    """White space collapsed and at most 180 characters, as declarations show."""
    return table(spark, d, "documents").select("doc_id", X.bounded(X.collapse(F.col("text")), 180).alias("context"))


_HEAD = "case page_id % 4 when 0 then '// Code generated by x. DO NOT EDIT.' when 1 then '# this file was generated' when 2 then 'generated file' else '/* hand made */' end || chr(10) || html"


@register("generated_marker", f"""with h as (select page_id, {_HEAD} as content from pages), l as (select page_id, unnest(string_split(content, chr(10))[1:16]) as line from h)
  select page_id, bool_or(regexp_matches(line, '^\\s*(//|#|/\\*|\\*|<!--|--)') and (regexp_matches(lower(line), '@generated|generated file|this file is generated|this file was generated|automatically generated') or (contains(lower(line), 'code generated') and contains(lower(line), 'do not edit')))) as generated from l group by page_id""")
def generated_marker(spark, d):
    k = F.col("page_id") % 4
    head = F.when(k == 0, "// Code generated by x. DO NOT EDIT.").when(k == 1, "# this file was generated").when(k == 2, "generated file").otherwise("/* hand made */")
    return table(spark, d, "pages").select("page_id", X.generated_marker(F.concat(head, F.lit("\n"), F.col("html"))).alias("generated"))


_MIN = "case page_id % 3 when 0 then repeat('x', 1200) when 1 then regexp_replace(html, '\\s', '', 'g') else html end"


@register("minified", f"""with m as (select page_id, {_MIN} as c from pages), s as (select *, octet_length(encode(c)) as size, len(string_split(regexp_replace(c, '\\n$', ''), chr(10))) as lines from m)
  select page_id, size between 1024 and 65536 and lines <= 3 and size // lines >= 512 and (length(c) - length(regexp_replace(c, '\\s', '', 'g'))) * 100 <= size * 2 as minified from s""")
def minified(spark, d):
    k = F.col("page_id") % 3
    content = F.when(k == 0, F.repeat(F.lit("x"), F.lit(1200))).when(k == 1, F.regexp_replace("html", r"\s", "")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", X.minified(F.lit("js"), content).alias("minified"))


@register("looks_generated", "select page_id, contains(lower(url), 'generated') or contains(lower(substr(html, 1, 512)), 'generated') as generated from pages")
def looks_generated(spark, d):
    return table(spark, d, "pages").select("page_id", X.looks_generated(F.col("url"), F.col("html")).alias("generated"))


@register("binary_content", "select page_id, page_id % 5 in (0, 1) as is_binary from pages")
def binary_content(spark, d):
    """Every fifth page with a NUL in front, every fifth with an invalid byte."""
    k, raw = F.col("page_id") % 5, F.encode("html", "utf-8")
    content = F.when(k == 0, F.concat(F.lit(b"\0"), raw)).when(k == 1, F.concat(F.lit(b"\xff"), raw)).otherwise(raw)
    return table(spark, d, "pages").select("page_id", X.binary(content).alias("is_binary"))


# --- times and numbers --------------------------------------------------------------------


@register("times", f"""with {COMMITS_SQL} select id, strftime(make_timestamp(t * 1000000), '%Y-%m') as month, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%SZ') as stamp,
  strftime(make_timestamp(t * 1000000), '%Y-%m-%dT00:00:00Z') as day, t >= {NOW} - 365 * 86400 as recent from (select id, case when id % 10 = 0 then -1 - id else author_seconds end as t from commits)""")
def times(spark, d):
    t = F.when(F.col("id") % 10 == 0, -1 - F.col("id")).otherwise(F.col("author_seconds"))
    return commits(spark, d).select("id", X.month(t).alias("month"), X.rfc3339(t).alias("stamp"), X.capture_date(t).alias("day"), X.in_window(t, NOW, 365).alias("recent"))


@register("scores", """select l_orderkey, l_linenumber, round(greatest(l_tax - 0.02, 0.0) * 1e6)::bigint as scaled, case when l_quantity > 10 then l_linenumber::bigint * 1024000 // (l_quantity::bigint - 10) end as rate,
  (l_linenumber * 100 // greatest(l_quantity::bigint, 1))::int as share from lineitem""")
def scores(spark, d):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", X.scaled_score(F.col("l_tax") - 0.02).alias("scaled"), X.churn_rate(n, q - 10).alias("rate"), X.share_percent(n, q).alias("share")
    )


@register("edge_weights", """with e as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'main' when 1 then '_x' else 'f' || l_partkey end as symbol, case when l_linenumber % 3 = 0 then 'medium' when l_linenumber % 3 = 1 then 'high' else 'low' end as confidence,
  case l_suppkey % 4 when 0 then 'public' when 1 then 'internal' when 2 then 'private' else 'unknown' end as visibility from lineitem)
  select l_orderkey, l_linenumber, round((case when lower(symbol) = 'main' or starts_with(symbol, '_') then 0.25 else 1 end::double) * (case confidence when 'high' then 1.0 when 'medium' then 0.5 else 0.25 end::double)
    * (case visibility when 'public' then 1.0 when 'internal' then 0.8 when 'private' then 0.35 else 0.7 end::double) * 1e6)::bigint as weight from e""")
def edge_weights(spark, d):
    n, s = F.col("l_linenumber"), F.col("l_suppkey") % 4
    symbol = F.when(n % 4 == 0, "main").when(n % 4 == 1, "_x").otherwise(F.concat(F.lit("f"), F.col("l_partkey")))
    confidence = F.when(n % 3 == 0, "medium").when(n % 3 == 1, "high").otherwise("low")
    visibility = F.when(s == 0, "public").when(s == 1, "internal").when(s == 2, "private").otherwise("unknown")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.scaled_score(M.edge_weight(symbol, confidence, visibility)).alias("weight"))


@register("module_hints", """select p_partkey, case p_partkey % 5 when 0 then 'pkg/x' || p_partkey when 1 then 'a.b' || p_partkey || ',a/b' || p_partkey when 2 then 'crate/m' || p_partkey || '/f'
  when 3 then 'lib/__init__' || '|' || p_partkey else '' end as hints from part""")
def module_hints(spark, d):
    """What import statements of made-up parts may mean."""
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    context = (
        F.when(k == 0, F.concat(F.lit('import x from "./pkg/x'), n, F.lit('.ts"'))).when(k == 1, F.concat(F.lit("local m = require('a.b"), n, F.lit("')")))
        .when(k == 2, F.concat(F.lit("use crate::m"), n, F.lit("::f;"))).when(k == 3, F.lit("from lib/__init__.py import y")).otherwise(F.lit("import os"))
    )
    lang = F.when(k == 1, "lua").otherwise("python")
    hints = F.when(k == 0, F.element_at(M.import_hints(context, lang), -1)).otherwise(F.array_join(M.import_hints(context, lang), ","))
    return table(spark, d, "part").select("p_partkey", F.when(k == 3, F.concat(hints, F.lit("|"), n)).otherwise(hints).alias("hints"))


@register("labels", """select c_custkey, upper(left(lower(c_mktsegment), 1)) || replace(substr(lower(c_mktsegment) || '_x_y', 2), '_', ' ') as label,
  case when c_custkey % 3 = 1 then 'mixed' when c_custkey % 3 = 2 then 'modified' when c_custkey % 5 = 0 then 'untracked' else 'clean' end as state,
  c_custkey % 4 = 1 as missing, c_custkey % 4 = 2 as actionable, c_custkey % 2 = 0 as projection, 'Analyzed ' || c_custkey || ' source files (go, rust) and recorded 2 omitted paths.' as summary from customer""")
def labels(spark, d):
    """Labels, states and messages made up by customer."""
    k = F.col("c_custkey")
    message = F.when(k % 4 == 1, "object Not Found here").when(k % 4 == 2, "the resource limit was met").when(k % 4 == 3, "The per-file symbol limit: resource limit").otherwise("fine")
    modified, untracked = (k % 3 != 0).cast("int"), F.when(k % 3 == 0, (k % 5 == 0).cast("int")).otherwise((k % 3 == 1).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", N.display_label(F.concat(F.lower("c_mktsegment"), F.lit("_x_y"))).alias("label"), N.snapshot_state(F.lit(1), modified, untracked).alias("state"), N.missing_object(message).alias("missing"),
        N.actionable_limitation(message).alias("actionable"), N.expected_projection(k % 2 == 0, F.lit("output_budget")).alias("projection"),
        N.map_summary(k, F.lit(2), F.array(F.lit("rust"), F.lit("go"), F.lit("go"))).alias("summary"),
    )


@register("explained_landmarks", f"""{WITH} select page_id, case when regexp_matches(path, '(^|/)README[.]md$') then 'readme' when regexp_matches(path, '/(Cargo[.]toml|package[.]json)$') then 'manifest' when contains(path, '/tests/') then 'tests' end as kind from paths""")
def explained_landmarks(spark, d):
    return page_paths(spark, d).select("page_id", N.explained_landmark(F.col("path")).alias("kind"))
