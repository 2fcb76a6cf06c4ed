"""Queries over what makes up a report: candidates of the plan, budgets, ceilings and cache runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.functions import modules as M
from wayfind.functions import paths as P
from wayfind.functions import text as X
from wayfind.operators import cache as C
from wayfind.operators import graph as G
from wayfind.operators import history as H
from wayfind.operators import inventory as I
from wayfind.operators import landmarks as K
from wayfind.operators import selection as S
from wayfind.plans import reading as R
from wayfind.plans import report
from wayfind.session import table
from wayfind.settings import HistorySettings, Limits
from wayfind.suite.adapters import COMMITS_SQL, NOW, PATHS_SQL, commit_paths, commits

# --- functions ----------------------------------------------------------------------------


def _choice(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


@register("git_internal", "with p as (select c_custkey, list_extract(['.git', '.git/config', 'src/.git', '.gitignore', '.git2/x'], (c_custkey % 5)::int + 1) as path from customer) select c_custkey, path = '.git' or starts_with(path, '.git/') as internal from p")
def git_internal(spark, d):
    path = _choice(F.col("c_custkey"), (".git", ".git/config", "src/.git", ".gitignore", ".git2/x"))
    return table(spark, d, "customer").select("c_custkey", P.git_internal(path).alias("internal"))


@register("object_format", "select c_custkey, case c_custkey % 3 when 0 then 'sha1' when 1 then 'sha256' end as format from customer")
def object_format(spark, d):
    length = F.when(F.col("c_custkey") % 3 == 0, 40).when(F.col("c_custkey") % 3 == 1, 64).otherwise(7)
    return table(spark, d, "customer").select("c_custkey", X.object_format(F.repeat(F.lit("a"), length)).alias("format"))


@register("qualified_symbols", "select p_partkey, replace(p_type, ' ', '::') || '::' || p_brand as symbol from part")
def qualified_symbols(spark, d):
    return table(spark, d, "part").select("p_partkey", M.qualified(F.split("p_type", " "), F.col("p_brand")).alias("symbol"))


# --- ceilings -----------------------------------------------------------------------------


@register(
    "bounded_collections",
    """with n as (select 'region' as name, count(*) as total from region union all select 'nation', count(*) from nation union all select 'supplier', count(*) from supplier)
    select name, total, least(total, 10) as returned, total > 10 as truncated, case when total > 10 then 'collection_limit' end as reason from n""",
)
def bounded_collections(spark, d):
    """What a history's ceiling on collections leaves of each, and says of it."""
    each = [I.collection_rows(name, table(spark, d, name), 10) for name in ("region", "nation", "supplier")]
    return each[0].unionAll(each[1]).unionAll(each[2])


@register("file_cap", "select 'f' || p_partkey as path from part order by path limit 100")
def file_cap(spark, d):
    """The ceiling on files, in order of path."""
    return G.first_per_order(table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("path")), ["path"], 100)


@register("finding_cap", "select 'f' || p_partkey as path, case when p_size % 2 = 0 then 'parse_error' else 'ambiguous_reference' end as kind, p_size::int as line from part order by path, line, kind limit 200")
def finding_cap(spark, d):
    """The ceiling on findings, in order of path."""
    kind = F.when(F.col("p_size") % 2 == 0, "parse_error").otherwise("ambiguous_reference")
    found = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("path"), kind.alias("kind"), F.col("p_size").cast("int").alias("line"))
    return G.first_per_order(found, ["path", "line", "kind"], 200)


@register(
    "compact_projection",
    """with f as (select 's' || s_suppkey as path, s_suppkey as k from supplier) select 'files' as collection, path from (select path from f order by path limit 32)
    union all select 'ranking', path from (select path from f order by k % 7 desc, path limit 16) union all select 'omissions', path from (select path from f order by path limit 8)""",
)
def compact_projection(spark, d):
    """What the compact profile shows of three collections."""
    files = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("path"), (F.col("s_suppkey") % 7).alias("score"))
    orders = {"files": ["path"], "ranking": [F.col("score").desc(), "path"], "omissions": ["path"]}
    shown = S.project(dict.fromkeys(orders, files), "compact", orders)
    parts = [df.select(F.lit(name).alias("collection"), "path") for name, df in shown.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- budgets ------------------------------------------------------------------------------

BUDGET = 400


@register(
    "snippet_selection",
    f"""with recursive s as (select row_number() over (order by p_partkey % 1000 desc, 'p' || p_partkey) as n, 'p' || p_partkey as path, p_partkey % 1000 as score, repeat(p_name || ' ', 1 + p_partkey % 7) as context,
      'p' || p_partkey || ' function ' || p_brand || ' ' || p_size || ':1-' || p_size || ':9 root' as prefix from part),
    walk as (select 0::bigint as n, 0::bigint as used, null::varchar as path, 0::bigint as score, null::varchar as context, 0::bigint as cost, false as cut, false as taken
      union all
      select n, used + case when taken then cost else 0 end, path, score, case when cut then left(context, room) || '…' else context end, cost, cut, taken from (
        select *, whole > left_over as cut, whole <= left_over or room >= 0 as taken, case when whole <= left_over then whole else ceil(length(prefix || ' ' || left(context, greatest(room, 0)) || '…') / 4.0)::bigint end as cost from (
          select s.n, w.used, s.path, s.score, s.context, s.prefix, greatest(1, ceil(length(s.prefix || ' ' || s.context) / 4.0)::bigint) as whole, {BUDGET} - w.used as left_over, 4 * ({BUDGET} - w.used) - length(s.prefix) - 2 as room
          from walk w join s on s.n = w.n + 1 where w.used < {BUDGET})))
    select path, score, context, cost as estimated_tokens, cut as truncated from walk where taken""",
)
def snippet_selection(spark, d):
    """Snippets by score under a budget of tokens; the last that fits is cut."""
    at = lambda column: F.struct(F.col("p_size").cast("int").alias("line"), F.lit(column).alias("column"))
    rows = table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("path"), F.lit("rust").alias("language"), F.lit("function").alias("kind"), F.col("p_brand").alias("name"),
        F.struct(at(1).alias("start"), at(9).alias("end")).alias("location"), F.array().cast("array<string>").alias("scope"),
        F.repeat(F.concat("p_name", F.lit(" ")), (1 + F.col("p_partkey") % 7).cast("int")).alias("context"), (F.col("p_partkey") % 1000).cast("long").alias("score"),
    )
    chosen = S.select_snippets(rows, BUDGET)["snippets"]
    return spark.createDataFrame([(c["path"], c["score"], c["context"], c["estimated_tokens"], c["truncated"]) for c in chosen], "path string, score bigint, context string, estimated_tokens bigint, truncated boolean")


@register(
    "payload_shrink",
    """with f as (select n_name as path, ceil(length(n_name) / 4.0)::bigint as t, row_number() over (order by n_nationkey) as n from nation),
    s as (select r_name as path, ceil(length(r_name) / 4.0)::bigint as t, row_number() over (order by r_regionkey) as n from region),
    rest as (select sum(t) as total from s), running as (select path, sum(t) over (order by n) as upto from f)
    select 'findings' as collection, path from running, rest where upto + total <= 40 union all select 'snippets', path from s""",
)
def payload_shrink(spark, d):
    """A payload gives up its last findings until it is within a budget of tokens."""
    named = lambda name, key, c, said: table(spark, d, name).select(F.lit(said).alias("collection"), F.col(key).cast("long").alias("place"), F.col(c).alias("path"))
    rows = named("nation", "n_nationkey", "n_name", "findings").unionAll(named("region", "r_regionkey", "r_name", "snippets"))
    return S.shrunk(rows.withColumn("tokens", S.text_tokens(rows, ["path"])), 40).select("collection", "path")


@register(
    "payload_shrink_parts",
    """with p as (select case p_size % 4 when 0 then 'findings' when 1 then 'edges' when 2 then 'files' else 'quality' end as collection, p_partkey as place, p_name as path, ceil(length(p_name) / 4.0)::bigint + ceil(length(p_type) / 4.0)::bigint as t from part),
    r as (select *, sum(t) over (order by case collection when 'files' then 1 when 'edges' then 2 else 3 end, place) as upto from p where collection <> 'quality'), h as (select sum(t) * 2 // 3 as half from p)
    select collection, path from r, h where upto <= half union all select collection, path from p where collection = 'quality'""",
)
def payload_shrink_parts(spark, d):
    """A payload of all parts is brought within two thirds of its tokens."""
    rows = table(spark, d, "part").select(_choice(F.col("p_size") % 4, ("findings", "edges", "files", "quality")).alias("collection"), F.col("p_partkey").cast("long").alias("place"), F.col("p_name").alias("path"), "p_type")
    rows = rows.withColumn("tokens", S.text_tokens(rows, ["path", "p_type"]))
    budget = rows.agg(F.floor(F.sum("tokens") * 2 / 3)).first()[0]
    return S.shrunk(rows, int(budget)).select("collection", "path")


@register(
    "payload_tokens",
    "select sum(ceil(length(n_name) / 4.0) + ceil(length(n_nationkey::varchar) / 4.0))::bigint as tokens from nation",
)
def payload_tokens(spark, d):
    """Tokens of every text in a payload."""
    rows = table(spark, d, "nation").select("n_name", "n_nationkey")
    return rows.agg(F.sum(S.text_tokens(rows, rows.columns)).alias("tokens"))


@register(
    "evidence_halving",
    "with n as (select n_name, row_number() over (order by n_nationkey) as k, count(*) over () as total from nation) select n_name from n where k <= total // 2 // 2",
)
def evidence_halving(spark, d):
    """The largest collection is halved until the report is within a size."""
    rows = [{"n_name": r[0]} for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]
    kept = S.halve({"nations": rows, "few": []}, 250)["nations"]
    return spark.createDataFrame([(r["n_name"],) for r in kept], "n_name string")


HEAD_BYTES, HEAD_TOP = 6_000, 300


@register(
    "head_budget",
    f"""with recursive {COMMITS_SQL}, {PATHS_SQL}, counts as (select path, count(*)::bigint as commits from commit_paths semi join windowed using (id) group by path),
    top as (select *, row_number() over (order by commits desc, path) as n from counts order by n limit {HEAD_TOP}),
    sized as (select top.*, octet_length(encode(repeat(p_name, 1 + p_partkey % 9)))::bigint as size from top join part on p_partkey = regexp_extract(path, '([0-9]+)$', 1)::bigint),
    walk as (select 0::bigint as n, 0::bigint as used, null::varchar as path, 0::bigint as commits, 0::bigint as size, true as fits
      union all select s.n, w.used + case when w.used + s.size <= {HEAD_BYTES} then s.size else 0 end, s.path, s.commits, s.size, w.used + s.size <= {HEAD_BYTES} from walk w join sized s on s.n = w.n + 1)
    select path, commits, size as size_bytes, case when fits then commits * 1024000 // size end as commits_per_kib_milli, case when fits then 'text' else 'resource_limit' end as size_status from walk where n > 0""",
)
def head_budget(spark, d):
    """Sizes at HEAD under a ceiling on all bytes: what would exceed it is passed over, and later files still count."""
    path = F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey"))
    blobs = table(spark, d, "part").select(path.alias("path"), F.repeat("p_name", F.col("p_partkey").cast("int") % 9 + 1).alias("content"))
    settings = HistorySettings(now=NOW, limits=Limits(source_bytes=HEAD_BYTES))
    return H.head_sizes(H.churn(commits(spark, d), commit_paths(spark, d), settings), blobs, settings, HEAD_TOP)


# --- the reading plan's evidence ----------------------------------------------------------

_TAILS = "list_extract(['/src/main.rs', '/lib.rs', '/src/x.rs', '/tests/t.py'], (s_suppkey % 4)::int + 1)"


@register(
    "reading_rows",
    f"""with f as (select s_suppkey as k, 'r' || s_suppkey as top, 'r' || s_suppkey || {_TAILS} as path, case when s_suppkey % 3 <> 0 then 'r' || s_suppkey end as project_root, s_suppkey * 10 as rank, s_suppkey % 2 as focus, (s_suppkey % 2) * 3 as links from supplier)
    select 'architecture' as purpose, path, project_root, rank as score, case when links > 0 then 'high' else 'medium' end as confidence, case when links > 0 then 'lexical edges link this ranked source with 3 file relationships' else 'ranked source kept as structural context' end as reason from f
    union all select case k % 4 when 0 then 'runtime' else 'architecture' end, path, project_root, 2800000000, 'high', 'conventional entry point of its project' from f where project_root is not null and k % 4 < 2
    union all select 'architecture', path, project_root, 2000000000 + 1000000, 'high', 'an explicit focus matched this path 1 times' from f where focus > 0
    union all select 'tests', path, project_root, 1500000000 + rank, 'high', 'source below a test directory' from f where k % 4 = 3
    union all select 'start_here', top || '/README.md', project_root, 3000000000 + 95 * 1000000, 'high', 'landmark: readme' from f where k % 5 = 1
    union all select 'supporting_context', path, project_root, 600000000 + 4 * 100000, 'medium', 'churn in 4 commits' from f where k % 6 = 0
    union all select 'supporting_context', path, project_root, 400000000 + 2 * 100000, 'medium', 'recovery commits in 2 commits' from f where k % 7 = 0""",
)
def reading_rows(spark, d):
    """Every contribution to a reading plan: ranks, entry points, focus, tests, landmarks and history."""
    k, top = F.col("s_suppkey"), F.concat(F.lit("r"), F.col("s_suppkey"))
    none = F.array().cast("array<string>")
    own = table(spark, d, "supplier").select("s_suppkey", top.alias("top"), F.concat(top, _choice(k, ("/src/main.rs", "/lib.rs", "/src/x.rs", "/tests/t.py"))).alias("path"))
    files = own.select("path", none.alias("limitations"))
    ranking = own.select("path", (k * 10).alias("score"), (k % 2).cast("int").alias("focus_matches"))
    links = own.where("s_suppkey % 2 = 1").select("path", F.lit(3).cast("long").alias("links"))
    roots = own.where("s_suppkey % 3 <> 0").select(F.col("top").alias("path"), F.lit("package").alias("kind"), none.alias("manifests"))
    readmes = own.select(F.concat("top", F.lit("/README.md")).alias("path"), "s_suppkey", "top")
    root = F.when(k % 3 != 0, F.col("top"))
    mark = lambda df, kind, priority: df.select("path", F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.lit(0).alias("focus_matches"), root.alias("project_root"))
    tests = own.where("s_suppkey % 4 = 3").select(F.concat("top", F.lit("/tests")).alias("path"), "s_suppkey", "top")
    marks = mark(readmes, "readme", 95).unionAll(mark(tests, "test_root", 70))
    counted = lambda n, commits: own.where(k % n == 0).select("path", F.lit(commits).cast("long").alias("commits"))
    none_counted = own.where("false").select("path", F.lit(0).cast("long").alias("commits"))
    omitted = readmes.where("s_suppkey % 5 = 1").select("path")
    rows = R.candidate_rows(files, ranking, links, marks, roots, omitted, counted(6, 4), none_counted, counted(7, 2))
    return rows.select("purpose", "path", "project_root", "score", "confidence", "reason")


@register(
    "root_totals",
    """with l as (select c_nationkey as k, count(*) as n from customer group by 1), r as (select s_nationkey as k, count(*) as n, string_agg('s' || s_suppkey, ',' order by s_suppkey) as paths from supplier group by 1)
    select 'n' || n_nationkey as path, coalesce(l.n, 0) as landmark_total, coalesce(r.n, 0) as recommendation_total, coalesce(r.paths, '') as recommended_paths from nation left join l on l.k = n_nationkey left join r on r.k = n_nationkey""",
)
def root_totals(spark, d):
    """Landmarks and recommendations in each project root."""
    root = lambda c: F.concat(F.lit("n"), F.col(c))
    marks = table(spark, d, "customer").select(root("c_nationkey").alias("project_root"))
    chosen = table(spark, d, "supplier").select(root("s_nationkey").alias("project_root"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("path"), F.col("s_suppkey").cast("int").alias("ordinal"))
    found = K.root_totals(table(spark, d, "nation").select(root("n_nationkey").alias("path")), marks, chosen)
    return found.withColumn("recommended_paths", F.array_join("recommended_paths", ","))


# --- states -------------------------------------------------------------------------------


@register(
    "availability",
    """select count(*) filter (n_nationkey % 5 = 0) as unsupported_paths, count(*) filter (n_nationkey % 4 = 1) as partial_files, count(*) filter (n_nationkey % 5 = 2) as cache_unavailable_paths,
      true as resource_limited, count(*) filter (n_nationkey % 5 = 3) as unsafe_paths, string_agg(n_name, ',' order by n_name) filter (n_nationkey % 4 = 1) as partial_path_names from nation""",
)
def availability(spark, d):
    """Counts and names of what a map could not show in full."""
    k, path = F.col("n_nationkey"), F.col("n_name").alias("path")
    files = table(spark, d, "nation").select(path, F.when(k % 4 == 1, "partial").otherwise("complete").alias("status"), F.array().cast("array<string>").alias("limitations"))
    omitted = table(spark, d, "nation").select(path, _choice(k, ("unsupported_language", "oversized", "cache_unavailable", "symlink", "binary")).alias("reason"))
    names = F.array_join("partial_path_names", ",").alias("partial_path_names")
    return I.availability_row(files, omitted).select("unsupported_paths", "partial_files", "cache_unavailable_paths", "resource_limited", "unsafe_paths", names)


_MODES = ("auto", "always", "files", "manual", "no_cache")


@register(
    "cache_modes",
    """with f as (select c_custkey as k, c_custkey % 5 = 0 as known, c_custkey % 3 = 0 as current, c_custkey % 7 = 0 as asked from customer),
    s as (select m as mode, case m when 'no_cache' then 'disabled' when 'always' then 'forced' when 'files' then case when asked then 'forced' when known and current then 'hit' else 'unavailable' end
      when 'manual' then case when known and current then 'hit' when known then 'stale' else 'unavailable' end else case when known and current then 'hit' else 'refreshed' end end as status from f, (select unnest(['auto', 'always', 'files', 'manual', 'no_cache']) as m))
    select mode, count(*) filter (status in ('hit', 'stale')) as hits, count(*) filter (status in ('refreshed', 'unavailable')) as misses, count(*) filter (status in ('refreshed', 'forced')) as refreshed,
      count(*) filter (status = 'stale') as stale, count(*) filter (status = 'unavailable') as unavailable from s group by mode""",
)
def cache_modes(spark, d):
    """What a run does with each file in each mode of the cache, counted."""
    k = F.col("c_custkey")
    keys = [F.lit("r").alias("repository_id"), k.cast("string").alias("path"), F.lit("go").alias("language"), F.lit("q").alias("query_digest")]
    files = table(spark, d, "customer").select(*keys, F.lit("now").alias("fingerprint"))
    records = table(spark, d, "customer").where("c_custkey % 5 = 0").select(*keys, F.when(k % 3 == 0, "now").otherwise("then").alias("fingerprint"), F.current_timestamp().alias("created_at"), F.lit(1).cast("long").alias("bytes"), F.lit("{}").alias("payload"))
    asked = table(spark, d, "customer").where("c_custkey % 7 = 0").select(k.cast("string").alias("path"))
    out = None
    for mode in _MODES:
        row = C.stats(C.plan(files, records, mode, asked)).select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionAll(row)
    return out


@register(
    "markdown_report",
    """select '# Regions' || chr(10) || chr(10) || '## Rows' || chr(10) || chr(10) || string_agg(n || '. r_regionkey: ' || r_regionkey || '; r_name: `' || r_name || '`', chr(10) order by n) || chr(10) as text
    from (select *, row_number() over (order by r_regionkey) as n from region)""",
)
def markdown_report(spark, d):
    """Rows as the Markdown sink writes them."""
    rows = report.rows_of(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(report.render_markdown({"title": "Regions", "rows": rows}),)], "text string")
