"""Queries over inventory, landmarks, cache and the graph."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.functions import paths as P
from wayfind.operators import cache as C
from wayfind.operators import graph as G
from wayfind.operators import inventory as I
from wayfind.operators import landmarks as K
from wayfind.plans import reading as R
from wayfind.session import table
from wayfind.settings import MapSettings
from wayfind.storage import materialize
from wayfind.suite import fixed as W
from wayfind.suite.adapters import EDGES_SQL, PAGE_PATHS_SQL, SYMBOLS_SQL, document_files, page_paths, symbols

WITH = f"with {PAGE_PATHS_SQL}"

# --- inventory ----------------------------------------------------------------------------

_STATES = f"""{WITH}, distinct_paths as (select path, min(page_id) as k from paths group by path),
 tracked as (select path, k % 11 = 0 as s from distinct_paths where k % 4 <> 0 and k % 13 <> 5), modified as (select path from distinct_paths where k % 6 = 1), seen as (select path, k % 7 = 0 as s from distinct_paths where k % 5 <> 0),
 merged as (select coalesce(t.path, v.path) as path, case when t.path is null then 'untracked' when t.path in (select path from modified) then 'modified' else 'tracked' end as state,
   coalesce(t.s, false) or coalesce(v.s, false) as symlink from tracked t full outer join seen v on t.path = v.path)"""


def _candidates(spark, d):
    base = page_paths(spark, d).groupBy("path").agg(F.min("page_id").alias("k"))
    tracked = base.where("k % 4 <> 0").select("path", (F.col("k") % 11 == 0).alias("symlink"))
    return I.candidates(tracked, base.where("k % 6 = 1").select("path"), base.where("k % 5 <> 0").select("path", (F.col("k") % 7 == 0).alias("symlink")), base.where("k % 13 = 5").select("path"))


@register("inventory_merge", f"{_STATES} select * from merged")
def inventory_merge(spark, d):
    """Tracked paths without submodules, united with the visible ones."""
    return _candidates(spark, d)


@register("inventory_counts", f"{_STATES} select count(*) filter (state in ('tracked', 'modified'))::bigint as tracked, count(*) filter (state = 'modified')::bigint as modified, count(*) filter (state = 'untracked')::bigint as untracked from merged")
def inventory_counts(spark, d):
    return I.inventory(_candidates(spark, d))


@register("ignored_anti", f"""{_STATES} select path from distinct_paths where path not in (select path from merged)
  and not list_has_any(string_split(lower(path), '/'), {list(W.GENERATED + W.VENDOR)}) and not regexp_matches(lower(path), '([.]map|[.]min[.][^/]*|_pb[.][^./]*)$')""")
def ignored_anti(spark, d):
    return I.ignored_paths(page_paths(spark, d).select("path"), _candidates(spark, d))


@register("modified_paths", """with i as (select page_id::varchar as path, case when page_id % 3 = 0 then html || 'x' else html end as c from pages), w as (select page_id::varchar as path, html as c from pages where page_id % 5 <> 0)
  select i.path from i left join w using (path) where w.c is null or w.c <> i.c""")
def modified_paths(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), "page_id", "html")
    index = pages.select("path", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).alias("content"))
    return I.modified_paths(index, pages.where("page_id % 5 <> 0").select("path", F.col("html").alias("content")))


@register("cache_requests", f"{WITH} select distinct path || case page_id % 4 when 0 then '' else '.gone' end as path, page_id % 4 = 0 as matched from paths")
def cache_requests(spark, d):
    asked = page_paths(spark, d).select(F.concat("path", F.when(F.col("page_id") % 4 == 0, "").otherwise(".gone")).alias("path"))
    return I.cache_requests(asked, page_paths(spark, d))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"


@register("omission_gates", f"""{WITH}, g as (select page_id, path, page_id % 17 = 3 as symlink, case page_id % 8 when 5 then null when 6 then chr(0) || html else html end as content from paths)
  select page_id, case when regexp_matches(path, '^(.*/)?README[.]md(/.*)?$') then 'explicit_exclusion' when symlink then 'symlink'
    when list_has_any(string_split(lower(path), '/'), {list(W.GENERATED + W.VENDOR)}) or regexp_matches(lower(path), '([.]map|[.]min[.][^/]*|_pb[.][^./]*)$') then 'classified'
    when lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) not in ('rs', 'ts', 'py', 'lua') then 'non_source'
    when content is null then 'read_error' when octet_length(encode(content)) > 1048576 then 'oversized' when contains(content, chr(0)) then 'binary' end as reason from g""")
def omission_gates(spark, d):
    """The first gate that each path fails."""
    k = F.col("page_id") % 8
    content = F.when(k == 6, F.concat(F.lit("\0"), F.col("html"))).when(k != 5, F.col("html"))
    found = page_paths(spark, d).select("page_id", "path", (F.col("page_id") % 17 == 3).alias("symlink"), content.alias("content"))
    return found.select("page_id", I.omission_reason(MapSettings(excludes=("README.md",))).alias("reason"))


@register("byte_budget", """with recursive s as (select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint as size, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as n from lineitem),
  f as (select l_orderkey, l_linenumber, l_partkey, size, n, size <= 60 as kept, case when size <= 60 then size else 0 end as used from s where n = 1
    union all select s.l_orderkey, s.l_linenumber, s.l_partkey, s.size, s.n, f.used + s.size <= 60, case when f.used + s.size <= 60 then f.used + s.size else f.used end from f join s on s.l_orderkey = f.l_orderkey and s.n = f.n + 1)
  select l_orderkey, l_linenumber, l_partkey, size, kept from f""")
def byte_budget(spark, d):
    """Each order as a repository whose lines are files: what does not fit its budget is passed over."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    return I.greedy_within(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "size", 60)


@register("byte_budget_single", """with s as (select l_orderkey, l_linenumber, l_quantity::bigint as size, row_number() over (order by l_orderkey, l_linenumber, l_quantity) as n from lineitem),
  folded as (select list_reduce(list_prepend({'used': 0::bigint, 'kept': []::bigint[], 'n': 0::bigint, 'size': 0::bigint}, list({'used': 0::bigint, 'kept': []::bigint[], 'n': n, 'size': size} order by n)),
    lambda a, x: case when a.used + x.size <= 2000 then {'used': a.used + x.size, 'kept': list_append(a.kept, x.n), 'n': 0::bigint, 'size': 0::bigint} else a end).kept as kept from s)
  select l_orderkey, l_linenumber, size, n in (select unnest(kept) from folded) as kept from s""")
def byte_budget_single(spark, d):
    """All lines as the files of one repository, under one budget: no task has them all."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return I.greedy_rounds(rows, [], ["l_orderkey", "l_linenumber"], "size", 2000)


@register("byte_budget_rounds", """with recursive s as (select l_orderkey % 7 as g, l_orderkey, l_linenumber, l_quantity::bigint as size, row_number() over (partition by l_orderkey % 7 order by l_orderkey, l_linenumber, l_quantity) as n from lineitem where l_orderkey % 50 < 7),
  f as (select g, l_orderkey, l_linenumber, size, n, size <= 300 as kept, case when size <= 300 then size else 0 end as used from s where n = 1
    union all select s.g, s.l_orderkey, s.l_linenumber, s.size, s.n, f.used + s.size <= 300, case when f.used + s.size <= 300 then f.used + s.size else f.used end from f join s on s.g = f.g and s.n = f.n + 1)
  select g, l_orderkey, l_linenumber, size, kept from f""")
def byte_budget_rounds(spark, d):
    """Seven repositories of many files each."""
    rows = table(spark, d, "lineitem").where("l_orderkey % 50 < 7").select((F.col("l_orderkey") % 7).alias("g"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("size"))
    return I.greedy_rounds(rows, ["g"], ["l_orderkey", "l_linenumber"], "size", 300)


# --- landmarks ----------------------------------------------------------------------------

_ROOTS = f"""{WITH}, manifests as (select distinct regexp_replace(path, '/[^/]*$', '') as root, path as manifest, case when ends_with(path, 'Cargo.toml') then 'rust' else 'node' end as family from paths where regexp_matches(path, '/(Cargo[.]toml|package[.]json)$')),
 roots as (select root as path, case when count(distinct family) > 1 then 'mixed' else 'package' end as kind, string_agg(manifest, '|' order by manifest) as manifests from manifests group by root)"""


def _roots(spark, d):
    return K.project_roots(page_paths(spark, d).select("path", F.lit("[package]").alias("content")))


@register("project_roots", f"{_ROOTS} select * from roots")
def project_roots(spark, d):
    return _roots(spark, d).select("path", "kind", F.array_join("manifests", "|").alias("manifests"))


@register("deepest_root", f"{_ROOTS}, tops as (select distinct split_part(path, '/', 1) as path from roots union select path from roots) select p.page_id, (select r.path from tops r where p.path = r.path or starts_with(p.path, r.path || '/') order by length(r.path) desc limit 1) as project_root from paths p")
def deepest_root(spark, d):
    """The longest root above each path: a prefix join made of equalities."""
    roots = _roots(spark, d).select("path")
    roots = roots.unionAll(roots.select(F.split_part("path", F.lit("/"), F.lit(1)))).distinct()
    return K.deepest_root(page_paths(spark, d).select("page_id", "path"), roots).select("page_id", "project_root")


@register("descendant_state", f"""{WITH}, s as (select path, case page_id % 23 when 0 then 1 when 1 then 2 else 3 end as o from paths), up as (select o, string_split(path, '/') as parts from s),
  e as (select o, array_to_string(parts[1:n], '/') as path from (select o, parts, unnest(range(1, len(parts))) as n from up) union all select o, '.' from up)
  select path, list_extract(['modified', 'untracked', 'tracked'], min(o)) as state from e group by path""")
def descendant_state(spark, d):
    k = F.col("page_id") % 23
    return K.directory_states(page_paths(spark, d).select("path", F.when(k == 0, "modified").when(k == 1, "untracked").otherwise("tracked").alias("state")))


@register("submodules", "select distinct 'mod/' || page_id as path from pages where page_id % 3 = 0")
def submodules(spark, d):
    """``path =`` lines of made-up .gitmodules texts."""
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('[submodule "m"]\n\tpath = mod/'), F.col("page_id"), F.lit("\n\turl = x"))).otherwise(F.lit("[core]\n# path x"))
    return K.declared_submodules(table(spark, d, "pages").select(line.alias("content")))


@register("nested_repositories", f"{WITH}, r as (select distinct regexp_replace(path, '/[^/]*$', '') as path from paths where page_id % 5 = 0) select path from r a where not exists (select 1 from r b where starts_with(a.path, b.path || '/'))")
def nested_repositories(spark, d):
    listing = page_paths(spark, d).where("page_id % 5 = 0").select(F.concat(P.parent(F.col("path")), F.lit("/.git")).alias("path"))
    return K.nested_repositories(listing)


@register("landmark_order", f"""{_ROOTS}, found as (
  select case kind when 'workspace' then 'workspace_root' else 'package_root' end as kind, split_part(manifests, '|', 1) as path from roots
  union select 'readme', path from paths where ends_with(path, '/README.md') union select 'manifest', path from paths where regexp_matches(path, '/(Cargo[.]toml|package[.]json)$')
  union select 'license', path from paths where ends_with(path, '/LICENSE') union select 'test_root', regexp_replace(path, '/[^/]*$', '') from paths where ends_with(path, '/tests/test_a.py')),
 kinds as (select unnest(['readme', 'manifest', 'license', 'test_root', 'package_root']) as kind, unnest([95, 85, 50, 70, 85]) as priority)
 select kind, path, priority, contains(lower(path), 'ththon')::int as focus_matches, (select r.path from roots r where f.path = r.path or starts_with(f.path, r.path || '/') order by length(r.path) desc limit 1) as project_root from found f join kinds using (kind)""")
def landmark_order(spark, d):
    files = page_paths(spark, d).select("path", F.lit("tracked").alias("state")).distinct()
    return K.landmarks(files, _roots(spark, d), MapSettings(focuses=("ththon",))).select("kind", "path", "priority", "focus_matches", "project_root")


# --- cache --------------------------------------------------------------------------------


def _records(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("repository_id"), F.col("event_id").cast("string").alias("path"), F.col("event_type").alias("language"), F.lit("q").alias("query_digest"),
        F.lpad((F.col("event_id") % 5).cast("string"), 2, "0").alias("fingerprint"), F.col("ts").alias("created_at"), (F.coalesce("value", F.lit(0.0)) * 1000).cast("long").alias("bytes"),
        F.col("event_id").cast("string").alias("payload"),
    )


_CACHE = "with r as (select user_id::varchar as repository_id, event_id::varchar as path, ts as created_at, trunc(coalesce(value, 0) * 1000)::bigint as bytes, event_type, event_id from events)"


@register("cache_retention", f"""{_CACHE}, young as (select * from r where created_at >= timestamp '2024-01-10'), p as (select *, row_number() over w as n, sum(bytes) over (w rows between unbounded preceding and current row) as s from young
  window w as (partition by repository_id order by created_at desc, path)) select repository_id, path from p where n <= 20 and s <= 1000000""")
def cache_retention(spark, d):
    """Records young enough, the newest of each repository up to a count and a size."""
    now = F.lit(datetime.datetime(2024, 2, 9)).cast("timestamp_ntz")
    return C.retained(_records(spark, d), now, max_records=20, max_bytes=1_000_000).select("repository_id", "path")


@register("cache_totals", f"{_CACHE} select repository_id, count(*)::bigint as records, sum(bytes)::bigint as bytes from r group by 1")
def cache_totals(spark, d):
    return C.totals(_records(spark, d))


def _lookup_sql(stale: bool) -> str:
    newest = "when n.payload is not null then 'stale'" if stale else ""
    other = "'miss'" if stale else "'refreshed'"
    return f"""with r as (select user_id, event_type, event_id % 5 as f, ts, event_id from events), e as (select user_id, event_type, f, max_by(event_id, ts)::varchar as payload from r group by all),
  n as (select user_id, event_type, max_by(event_id, ts)::varchar as payload from r group by all), files as (select distinct user_id, event_type, 3 as f from (select user_id from events) cross join (values ('click'), ('view'), ('none')) t(event_type))
  select files.user_id::varchar as repository_id, files.event_type as language, case when e.payload is not null then 'hit' {newest} else {other} end as status,
    {'coalesce(e.payload, n.payload)' if stale else 'e.payload'} as payload from files left join e using (user_id, event_type, f) left join n on n.user_id = files.user_id and n.event_type = files.event_type"""


def _lookup(spark, d, mode):
    cache = _records(spark, d).withColumn("path", F.lit("p"))
    kinds = F.explode(F.array(*map(F.lit, ("click", "view", "none"))))
    files = cache.select("repository_id").distinct().select("repository_id", F.lit("p").alias("path"), kinds.alias("language"), F.lit("q").alias("query_digest"), F.lit("03").alias("fingerprint"))
    return C.lookup(files, cache, mode).select("repository_id", "language", F.col("cache_status").alias("status"), "payload")


@register("cache_lookup", _lookup_sql(False))
def cache_lookup(spark, d):
    return _lookup(spark, d, "auto")


@register("cache_lookup_manual", _lookup_sql(True))
def cache_lookup_manual(spark, d):
    return _lookup(spark, d, "manual")


# --- graph --------------------------------------------------------------------------------


def _symbols(spark, d):
    """The symbols, read from the texts once for all the tiers that use them."""
    return materialize(symbols(spark, d), "symbols")


@register("def_index", f"with {SYMBOLS_SQL} select language, name, count(distinct path)::bigint as paths, min(visibility) as visibility from defs_raw group by all")
def def_index(spark, d):
    """Defining files of each name, apart from modules."""
    own = symbols(spark, d).where("kind <> 'module'")
    return G.definitions(own).groupBy("language", "name").agg(F.count(F.lit(1)).alias("paths"), F.min("visibility").alias("visibility"))


@register("lexical_edges", f"with {EDGES_SQL} select source, target, symbol, ambiguous, candidate_group, resolution_reason, confidence, target_visibility from edges")
def lexical_edges(spark, d):
    return G.lexical_edges(_symbols(spark, d)).drop("candidates")


@register("degrees", f"with {EDGES_SQL}, ends as (select source as path, 0 as i, 1 as o from edges union all select target, 1, 0 from edges) select path, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, count(*)::bigint as links from ends group by path")
def degrees(spark, d):
    return G.degrees(G.lexical_edges(_symbols(spark, d)))


@register("reference_counts", f"with {EDGES_SQL} select target as path, symbol as name, count(*)::bigint as \"references\" from edges group by all")
def reference_counts(spark, d):
    return G.reference_counts(G.lexical_edges(_symbols(spark, d)))


@register("ambiguity_groups", f"with {EDGES_SQL} select candidate_group, min(source) as path, min(symbol) as symbol, max(n_candidates)::bigint as candidates from edges where ambiguous group by candidate_group")
def ambiguity_groups(spark, d):
    return G.ambiguity_groups(G.lexical_edges(_symbols(spark, d)))


@register("edge_cap", f"with {EDGES_SQL}, o as (select edges.*, row_number() over (order by source, refs.seq, target) as n from edges join refs on refs.path = source and refs.name = symbol) select source, target, symbol from o where n <= 100")
def edge_cap(spark, d):
    """The ceiling on edges in scan order (a feature of the reference's profile)."""
    return G.lexical_edges(_symbols(spark, d), max_edges=100).select("source", "target", "symbol")


@register("symbol_caps", f"with {SYMBOLS_SQL}, s as (select path, row_number() over (partition by path order by seq) as n, seq from refs_raw), c as (select * from s where n <= 3) select path, seq::int as seq from c order by path, seq limit 2000")
def symbol_caps(spark, d):
    """References up to three a file, then 2,000 in order of path (ceilings are the feature)."""
    capped = G.per_file_cap(symbols(spark, d).where("role = 'reference' and lower(name) not in ('data','default','error','item','key','main','new','result','self','value')"), 3)
    return G.first_per_order(capped, ["path", "seq"], 2_000).select("path", "seq")


def _supplier_edges(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity")
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    pairs = l.select(F.col("l_suppkey").cast("string").alias("source"), after.cast("string").alias("target"), (1 + F.col("l_linenumber") % 3).cast("double").alias("weight"))
    return pairs.where("target is not null and source not like '%7'")


def _rank_sql() -> str:
    passes = ", ".join(
        f"r{k} as (select n.path, 0.15 / t.n + 0.85 * (coalesce(m.got, 0) + t.lost / t.n) as rank from nodes n cross join (select count(*)::double as n, coalesce(sum(rank) filter (path not in (select source from share)), 0) as lost from r{k - 1}) t"
        f" left join (select target as path, sum(share * rank) as got from share join r{k - 1} on path = source group by target) m using (path))"
        for k in range(1, G.ITERATIONS + 1)
    )
    return f"""with nodes as (select s_suppkey::varchar as path from supplier), e as (select l_suppkey::varchar as source, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)::varchar as target, (1 + l_linenumber % 3)::double as weight from lineitem),
  w as (select source, target, sum(weight) as weight from e where target is not null and source not like '%7' group by all), share as (select source, target, weight / sum(weight) over (partition by source) as share from w),
  r0 as (select path, 1.0::double / (select count(*) from nodes) as rank from nodes), {passes}"""


_RANKED = f"{_rank_sql()} select path, round((rank + case when path like '1%' then 0.35 else 0 end + case when path = '5' then 0.7 else 0 end) * 1e6)::bigint as score, ((path like '1%')::int + (path = '5')::int)::int as focus_matches from r{G.ITERATIONS}"


def _ranked(spark, d, small):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"))
    matches = nodes.select("path", F.col("path").startswith("1").cast("int").alias("text_matches"), (F.col("path") == "5").alias("path_match"))
    return G.file_ranking(G.page_rank(nodes, _supplier_edges(spark, d), small=small), matches)


@register("page_rank", _RANKED)
def page_rank(spark, d):
    """24 passes over the suppliers that follow each other in an order, with focus boosts."""
    return _ranked(spark, d, None)


@register("page_rank_distributed", _RANKED)
def page_rank_distributed(spark, d):
    """The same as joins and aggregations, whatever the graph's size."""
    return _ranked(spark, d, 0)


@register("focus_matches_many", f"""with {SYMBOLS_SQL}, f as (select distinct path from lines), terms as (select chr((97 + i // 10)::int) || chr((97 + i % 10)::int) || case when i % 3 = 0 then 'n' else '' end as t from (select unnest(range(200)) as i)),
 hits as (select path, t from f, terms where contains(lower(path), t) union select path, t from words, terms where contains(lower(first_word), t) or (first_word <> '' and contains(lower(line), t))
   or (((length(line) > 100) or (seq = 2 and doc_id % 3 = 0)) and contains(lower(last_word), t)))
 select f.path, count(t)::int as text_matches, false as path_match from f left join hits using (path) group by f.path""")
def focus_matches_many(spark, d):
    """Two hundred focus terms at once."""
    own = _symbols(spark, d)
    terms = tuple(chr(97 + i // 10) + chr(97 + i % 10) + ("n" if i % 3 == 0 else "") for i in range(200))
    return G.focus_matches(own, document_files(spark, d), terms, ())


@register("focus_matches", f"""with {SYMBOLS_SQL}, f as (select distinct path from lines), s as (select path, bool_or(contains(lower(first_word), 'thon') or (first_word <> '' and contains(lower(line), 'thon'))) as a, bool_or(contains(lower(first_word), 'que') or (first_word <> '' and contains(lower(line), 'que'))) as b,
  bool_or(length(line) > 100 and contains(lower(last_word), 'thon')) as c, bool_or(length(line) > 100 and contains(lower(last_word), 'que')) as e, bool_or(seq = 2 and doc_id % 3 = 0 and contains(lower(last_word), 'thon')) as g, bool_or(seq = 2 and doc_id % 3 = 0 and contains(lower(last_word), 'que')) as h from words group by path)
  select path, ((a or c or g)::int + (b or e or h)::int)::int as text_matches, starts_with(path, 'pkg1/') as path_match from f join s using (path)""")
def focus_matches(spark, d):
    own = _symbols(spark, d)
    return G.focus_matches(own, document_files(spark, d), ("Thon", "que "), ("pkg1/",))


@register("snippet_scores", f"""with {EDGES_SQL}, c as (select target as path, symbol as name, count(*) as n from edges group by all)
  select words.path, first_word as name, seq::int * 3 - 2 as seq, (doc_id % 1000 + coalesce(n, 0) * 1000 + contains(lower(line), 'thon')::bigint * 250000)::bigint as score
  from words left join c on c.path = words.path and c.name = first_word where first_word <> ''""")
def snippet_scores(spark, d):
    """Scores of declarations by file, use and focus."""
    own = _symbols(spark, d)
    ranking = own.select("path").distinct().withColumn("score", F.regexp_extract("path", "f([0-9]+)", 1).cast("long") % 1000)
    scored = G.snippet_scores(own.where("kind = 'function'"), ranking, G.reference_counts(G.lexical_edges(own)), ("thon",))
    return scored.select("path", "name", "seq", "score")


# --- reading plan -------------------------------------------------------------------------


def _contributions(spark, d):
    own = table(spark, d, "lineitem").select(
        F.element_at(F.array(*map(F.lit, ("start_here", "architecture", "runtime", "tests", "supporting_context"))), F.col("l_linenumber") % 5 + 1).alias("purpose"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("path"), F.concat(F.lit("r"), F.col("l_suppkey") % 9).alias("project_root"),
        F.array(F.when(F.col("l_orderkey") % 2 == 0, "graph").otherwise("landmark"), F.lit("source_map")).alias("evidence_kinds"), F.concat(F.lit("why "), F.col("l_returnflag")).alias("reason"),
        F.array(F.col("l_linestatus")).alias("limitations"), F.col("l_quantity").cast("long").alias("score"), F.when(F.col("l_orderkey") % 3 == 0, "high").when(F.col("l_orderkey") % 3 == 1, "medium").otherwise("low").alias("confidence"),
    )
    return R.combine(own)


_COMBINED = """with c as (select list_extract(['start_here', 'architecture', 'runtime', 'tests', 'supporting_context'], l_linenumber % 5 + 1) as purpose, 'p' || l_partkey as path, min('r' || (l_suppkey % 9)) as project_root,
  case when bool_or(l_orderkey % 2 = 1) and bool_or(l_orderkey % 2 = 0) then 'landmark,source_map,graph' when bool_or(l_orderkey % 2 = 0) then 'source_map,graph' else 'landmark,source_map' end as evidence,
  string_agg(distinct 'why ' || l_returnflag, '; ' order by 'why ' || l_returnflag) as reasons, sum(l_quantity::bigint)::bigint as score, list_extract(['high', 'medium', 'low'], min(l_orderkey % 3)::int + 1) as confidence from lineitem group by 1, 2)"""


@register("reading_candidates", f"{_COMBINED} select * from c")
def reading_candidates(spark, d):
    return _contributions(spark, d).select("purpose", "path", "project_root", F.array_join("evidence_kinds", ",").alias("evidence"), F.array_join("reasons", "; ").alias("reasons"), "score", "confidence")


@register("reading_best", f"""{_COMBINED}, b as (select *, row_number() over (partition by purpose order by score desc, array_position(['high', 'medium', 'low'], confidence), path) as n from c) select purpose, path, score from b where n = 1""")
def reading_best(spark, d):
    """The best candidate of each purpose."""
    strength = F.array_position(F.array(*map(F.lit, ("high", "medium", "low"))), F.col("confidence"))
    best = Window.partitionBy("purpose").orderBy(F.col("score").desc(), strength, "path")
    return _contributions(spark, d).withColumn("n", F.row_number().over(best)).where("n = 1").select("purpose", "path", "score")


@register(
    "reading_plan",
    """with recursive c as (select list_extract(['start_here', 'architecture', 'runtime', 'tests', 'supporting_context'], l_linenumber % 5 + 1) as purpose, 'p' || l_partkey as path, min('r' || (l_suppkey % 9)) as project_root,
      array_to_string(list_sort(list(distinct 'why ' || l_returnflag))[1:2], '; ') as reason, sum(l_quantity::bigint)::bigint as score, min(l_orderkey % 3)::int as weakness from lineitem group by 1, 2),
    pick as (select 0 as step, []::varchar[] as taken, null::varchar as purpose, null::varchar as path, null::varchar as project_root, null::varchar as reason, 0::bigint as score
      union all select step, taken, purpose, path, project_root, reason, score from (
        select step + 1 as step, list_append(taken, c.path) as taken, c.purpose, c.path, c.project_root, c.reason, c.score, row_number() over (order by c.score desc, weakness, c.path, c.purpose) as n
        from pick join c on not list_contains(taken, c.path) and case when step < 5 then c.purpose = list_extract(['start_here', 'architecture', 'runtime', 'tests', 'supporting_context'], step + 1) else c.project_root = 'r' || (step - 5) end
        where step < 10) where n = 1)
    select row_number() over (order by list_position(['start_here', 'architecture', 'runtime', 'tests', 'supporting_context'], purpose), score desc, path)::int as ordinal, purpose, path, project_root, reason from pick where step > 0""",
)
def reading_plan(spark, d):
    """The whole sequential choice of ten paths: the best of each purpose, then of each root."""
    roots = [{"path": f"r{k}", "manifests": []} for k in range(9)]
    chosen = R.choose(R.shortlist(_contributions(spark, d)), roots)["recommendations"]
    return spark.createDataFrame([(c["ordinal"], c["purpose"], c["path"], c["project_root"], c["reason"]) for c in chosen], "ordinal int, purpose string, path string, project_root string, reason string")


@register("quality_flags", """with f as (select page_id % 7 = 0 as partial, page_id % 9 = 0 as stale, page_id % 50 = 3 as cut from pages), o as (select list_extract(['oversized', 'unsupported_language', 'unsafe_path', 'binary'], (page_id % 4)::int + 1) as reason from pages)
  select bool_or(stale) as stale, bool_or(cut) or (select bool_or(reason = 'oversized') from o) as resource_limit, false as incomplete, (select bool_or(reason = 'unsafe_path') from o) as unsafe_path, (select bool_or(reason = 'unsupported_language') from o) as unsupported,
    bool_or(partial) as partial, concat_ws(',', case when bool_or(stale) then 'stale' end, case when bool_or(cut) or (select bool_or(reason = 'oversized') from o) then 'resource_limit' end, case when (select bool_or(reason = 'unsafe_path') from o) then 'unsafe_path' end,
    case when (select bool_or(reason = 'unsupported_language') from o) then 'unsupported' end, case when bool_or(partial) then 'partial' end) as issues from f""")
def quality_flags(spark, d):
    """Flags over made-up states of pages as files."""
    from wayfind.plans.explain import quality

    k, none = F.col("page_id"), F.array().cast("array<string>")
    files = table(spark, d, "pages").select(
        F.col("url").alias("path"), F.when(k % 7 == 0, "partial").otherwise("complete").alias("status"), F.when(k % 50 == 3, F.array(F.lit("a resource limit was met"))).otherwise(none).alias("limitations"),
        F.when(k % 9 == 0, "stale").otherwise("hit").alias("cache_status"),
    )
    reasons = F.element_at(F.array(*map(F.lit, ("oversized", "unsupported_language", "unsafe_path", "binary"))), (k % 4 + 1).cast("int"))
    found = quality(None, files, table(spark, d, "pages").select(F.col("url").alias("path"), reasons.alias("reason")), stale=False, history_complete=True)
    return found.withColumn("issues", F.array_join("issues", ","))


@register("explain_path", f"""with {EDGES_SQL}, t as (select min(source) as path from edges) select distinct source, target, symbol from edges, t where source = t.path or target = t.path""")
def explain_path(spark, d):
    """The edges that bear on one path, here the first source of the graph."""
    from wayfind.plans.explain import explain
    own = _symbols(spark, d)
    edges = materialize(G.lexical_edges(own), "edges")
    path = edges.agg(F.min("source")).first()[0] or "none"
    files, none = own.select("path").distinct(), spark.createDataFrame([], "path string, commits long")
    omitted, found = spark.createDataFrame([], "path string, reason string"), spark.createDataFrame([], "path string, kind string")
    return explain(path, files, own, edges, files.withColumn("score", F.lit(0)), found, omitted, none, none)["edges"].select("source", "target", "symbol")


@register("explain_symbol", f"""with {EDGES_SQL}, t as (select min(symbol) as name from edges), files as (select distinct path from words where first_word <> '' or (last_word <> '' and length(line) > 100) or (seq = 1 and language = 'go') or (seq = 2 and doc_id % 3 = 0 and last_word <> '')),
  s as (select path, first_word as name, seq * 3 - 2 as seq from words where first_word <> '' union all select path, last_word, seq * 3 - 1 from words where seq = 2 and doc_id % 3 = 0 and last_word <> ''
    union all select path, last_word, seq * 3 from words where last_word <> '' and length(line) > 100 union all select path, 'm' || (doc_id % 5), 0 from words where seq = 1 and language = 'go'),
  matched as (select s.path, s.seq from s, t where s.name = t.name), paths as (select distinct path from matched)
  select 'symbols' as part, path, seq::varchar as detail from (select * from matched order by path, seq limit 128)
  union all select 'edges', source, target || ' ' || symbol from (select distinct source, target, symbol from edges, t where source in (from paths) or target in (from paths) or symbol = t.name order by source, target, symbol limit 128)
  union all select 'findings', path, 'parse_error' from paths where length(path) % 2 = 0
  union all select 'history', path, case when length(path) % 3 = 0 then length(path) || ' churn' else '1 bug_overlap' end from paths
  union all select 'omissions', path, 'oversized' from (select path from files where length(path) % 2 = 1 order by path limit 32)""")
def explain_symbol(spark, d):
    """All that bears on one name: symbols, edges, findings and history of its files; and what is said of a name that nothing has."""
    from wayfind.plans.explain import explain

    own = _symbols(spark, d).withColumn("scope", F.array().cast("array<string>"))
    edges = materialize(G.lexical_edges(own), "edges")
    name = edges.agg(F.min("symbol")).first()[0] or "none"
    files, size = own.select("path").distinct(), F.length("path")
    found, omitted = files.where(size % 2 == 0).withColumn("kind", F.lit("parse_error")), files.where(size % 2 == 1).withColumn("reason", F.lit("oversized"))
    churned, bugs = files.where(size % 3 == 0).withColumn("commits", size.cast("long")), files.withColumn("commits", F.lit(1).cast("long"))
    asked = lambda target: explain(target, files, own, edges, files.withColumn("score", F.lit(0)), found, omitted, churned, bugs)
    said, other = asked(name), asked("a name that no file has")
    part = lambda of, kind, detail, path="path": of[kind].select(F.lit(kind).alias("part"), F.col(path).alias("path"), detail.alias("detail"))
    rows = part(said, "symbols", F.col("seq").cast("string")).unionAll(part(said, "edges", F.concat_ws(" ", "target", "symbol"), "source"))
    rows = rows.unionAll(part(said, "findings", F.col("kind"))).unionAll(part(said, "history", F.concat_ws(" ", F.col("commits").cast("string"), "signal")))
    return rows.unionAll(part(other, "omissions", F.col("reason")))


@register("parse_sources", "select doc_id::varchar as path, 'f' || (doc_id % 10) as name, 'Class' || (doc_id % 3) as container from documents")
def parse_sources(spark, d):
    """A made-up source around every whole document: its method is found despite the text beside it."""
    from wayfind.sources.parser import parse_files

    body = F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("")), F.lit(" */\nclass Class"), F.col("doc_id") % 3, F.lit(" {\n  f"), F.col("doc_id") % 10, F.lit("(x) {\n    return 1;\n  }\n}\n"))
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("javascript").alias("language"), body.cast("binary").alias("content"))
    return parse_files(files).where("kind = 'method' and role = 'definition'").select("path", "name", F.element_at("scope", 1).alias("container"))


@register("capabilities", """select * from (values ('rust', 'rs', true), ('javascript', 'js,mjs,cjs', true), ('javascript_jsx', 'jsx', true), ('typescript', 'ts,mts,cts', true), ('typescript_tsx', 'tsx', true),
  ('python', 'py,pyi', true), ('ruby', 'rb,rake,gemspec', true), ('java', 'java', true), ('c_sharp', 'cs', true), ('go', 'go', true), ('lua', 'lua,rockspec', true)) as c(language, extensions, structural)""")
def capabilities(spark, d):
    from wayfind.plans.report import capabilities as known

    return known(spark).withColumn("extensions", F.array_join("extensions", ","))


@register("doctor")
def doctor(spark, d):
    from wayfind.plans.report import doctor as checks

    return checks(spark).drop("detail")


@register("json_rows", "select c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' as json from customer")
def json_rows(spark, d):
    """Rows as JSON, as the sink writes them."""
    from wayfind.plans.report import as_json_column

    rows = as_json_column(table(spark, d, "customer").select("c_custkey", "c_name"))
    return rows.select(F.get_json_object("json", "$.c_custkey").cast("long").alias("c_custkey"), "json")
