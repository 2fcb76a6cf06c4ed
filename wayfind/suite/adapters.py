"""The driver's tables as the engine's relations, in Spark and in SQL.

The tables hold no Git data, so these views stand in for it: orders are commits, lineitems
their changed paths, documents source files, their lines symbols. Adapters are part of the
tests' data, not of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.session import table

#: 2001-08-01 in UTC: the reference time of all windows.
NOW = 996_624_000

COMMITS_SQL = f"""
commits as (
  select o_orderkey as id, o_custkey, epoch(o_orderdate)::bigint as committer_seconds, epoch(o_orderdate)::bigint - 86400 * (o_custkey % 5) as author_seconds,
    o_orderpriority || ' ' || case o_orderkey % 6 when 0 then 'Fix parser bug' when 1 then 'prefix debug' when 2 then 'hotfix: Rollback entrypoint'
      when 3 then 'broken build' else 'Implement feature' end as message,
    o_orderstatus = 'P' as is_merge
  from orders),
windowed as (select * from commits where not is_merge and committer_seconds >= {NOW} - 365 * 86400)"""
PATHS_SQL = """
commit_paths as (
  select distinct l_orderkey as id, 'src/' || replace(p_type, ' ', '_') || '/' || p_brand || '/' || l_partkey as path from lineitem join part on l_partkey = p_partkey)"""


def commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 6 == 0, "Fix parser bug").when(F.col("o_orderkey") % 6 == 1, "prefix debug").when(F.col("o_orderkey") % 6 == 2, "hotfix: Rollback entrypoint")
    said = said.when(F.col("o_orderkey") % 6 == 3, "broken build").otherwise("Implement feature")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        (-F.col("o_orderkey")).alias("seq"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("parents"),
        F.concat(F.lit("Person "), F.col("o_custkey") % 97).alias("author_name"),
        F.concat(F.lit(" P"), F.col("o_custkey") % 97, F.lit("@Example.com")).alias("author_email"),
        (seconds - 86_400 * (F.col("o_custkey") % 5)).alias("author_seconds"), seconds.alias("committer_seconds"),
        F.concat_ws(" ", "o_orderpriority", said).alias("message"),
    )


def commit_paths(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    path = F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("l_partkey"))
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), path.alias("path"))


#: A page's url as a repository path, with made-up directories and names by its id.
PAGE_PATHS_SQL = """
page_paths as (
  select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') ||
    case page_id % 12 when 0 then '/target/app.js' when 1 then '/src/main.rs' when 2 then '/vendor/Lib.min.js' when 3 then '/tests/test_a.py' when 4 then '/README.md'
      when 5 then '/Cargo.toml' when 6 then '/src/index.ts' when 7 then '/gen/api_pb.go' when 8 then '/style.css.map' when 9 then '/package.json' when 10 then '/LICENSE' else '/lib/util.lua' end as raw,
    html from pages),
paths as (select page_id, regexp_replace(regexp_replace(raw, '/+', '/', 'g'), '^/', '') as path, html from page_paths)"""


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    tails = ["/target/app.js", "/src/main.rs", "/vendor/Lib.min.js", "/tests/test_a.py", "/README.md", "/Cargo.toml", "/src/index.ts", "/gen/api_pb.go", "/style.css.map", "/package.json", "/LICENSE", "/lib/util.lua"]
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("page_id") % 12 + 1).cast("int"))
    raw = F.concat(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), tail)
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(raw, "/+", "/"), "^/", "").alias("path"), "html")


#: Lines of documents as symbols. A line's first word is defined; a line of over 100 characters
#: has a call of its last word, and every third document imports by its second line.
SYMBOLS_SQL = r"""
lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as seq, unnest(string_split(text, chr(10))) as line,
    case lang when 'en' then 'go' when 'de' then 'rust' when 'fr' then 'python' else 'javascript' end as language,
    'pkg' || (doc_id % 40) || '/d' || (doc_id % 7) || '/f' || doc_id || case lang when 'en' then '.go' when 'de' then '.rs' when 'fr' then '.py' else '.js' end as path
  from documents),
words as (
  select *, regexp_extract(line, '^[^\p{L}]*(\p{L}+)', 1) as first_word, regexp_extract(line, '(\p{L}+)[^\p{L}]*$', 1) as last_word from lines),
defs_raw as (
  select path, language, first_word as name, case seq % 3 when 0 then 'public' when 1 then 'private' else 'unknown' end as visibility from words where first_word <> ''),
refs_raw as (
  select path, language, last_word as name, seq * 3 as seq from words where last_word <> '' and length(line) > 100 and lower(last_word) not in ('data','default','error','item','key','main','new','result','self','value')),
imports_raw as (
  select path, language, last_word as name, 'pkg' || (doc_id % 40) || '/d' || ((doc_id + 1) % 7) as hint from words where seq = 2 and doc_id % 3 = 0 and last_word <> ''),
modules_raw as (select distinct path, 'm' || (regexp_extract(path, 'f([0-9]+)', 1)::bigint % 5) as module from words where language = 'go')"""


def _document_path() -> Column:
    ext = F.when(F.col("lang") == "en", ".go").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".py").otherwise(".js")
    part = lambda n: (F.col("doc_id") % n).cast("string")
    return F.concat(F.lit("pkg"), part(40), F.lit("/d"), part(7), F.lit("/f"), F.col("doc_id").cast("string"), ext)


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """(path) of every document that has lines, with symbols in them or not."""
    return table(spark, d, "documents").where("text is not null").select(_document_path().alias("path")).distinct()


def symbols(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "go").when(F.col("lang") == "de", "rust").when(F.col("lang") == "fr", "python").otherwise("javascript")
    part = lambda n: (F.col("doc_id") % n).cast("string")
    lines = table(spark, d, "documents").select("doc_id", lang.alias("language"), _document_path().alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    first, last = F.regexp_extract("line", r"^[^\p{L}]*(\p{L}+)", 1), F.reverse(F.regexp_extract(F.reverse(F.col("line")), r"^[^\p{L}]*(\p{L}+)", 1))
    seq = F.col("pos") + 1
    visible = F.when(seq % 3 == 0, "public").when(seq % 3 == 1, "private").otherwise("unknown")
    make = lambda on, name, kind, role, seq, context, visibility, evidence: F.when(on, F.struct(
        name.alias("name"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), seq.cast("int").alias("seq"), context.alias("context"), visibility.alias("visibility"), F.lit(evidence).alias("evidence")
    ))
    nothing, unknown = F.lit(None).cast("string"), F.lit("unknown")
    hint = F.concat(F.lit("from pkg"), part(40), F.lit("/d"), ((F.col("doc_id") + 1) % 7).cast("string"))
    made = F.array_compact(F.array(
        make(first != "", first, "function", "definition", seq * 3 - 2, F.col("line"), visible, "declaration"),
        make((seq == 2) & (F.col("doc_id") % 3 == 0) & (last != ""), last, "import", "definition", seq * 3 - 1, hint, unknown, "import"),
        make((last != "") & (F.length("line") > 100), last, "identifier", "reference", seq * 3, nothing, unknown, "call"),
        make((F.col("pos") == 0) & (F.col("language") == "go"), F.concat(F.lit("m"), part(5)), "module", "definition", F.lit(0), nothing, unknown, "declaration"),
    ))
    return lines.select("path", "language", F.explode(made).alias("s")).select("path", "language", "s.*")


EDGES_SQL = SYMBOLS_SQL + """,
defs as (select language, name, path as target, min(visibility) as target_visibility from (
  select path, language, name, visibility from defs_raw union all
  select m.path, 'go', m.module, 'unknown' from modules_raw m) group by all),
refs as (select language, name, path, min(seq) as seq from refs_raw group by all),
own as (select r.*, d.target, d.target_visibility, 0 as tier from refs r join defs d on r.language = d.language and r.name = d.name and r.path = d.target),
away as (select r.* from refs r where not exists (select 1 from own o where o.language = r.language and o.name = r.name and o.path = r.path)),
same_module as (
  select r.*, d.target, d.target_visibility, 1 as tier from away r join defs d on r.language = d.language and r.name = d.name
  join modules_raw a on a.path = r.path join modules_raw b on b.path = d.target and a.module = b.module
  where r.language = 'go' and regexp_replace(r.path, '/[^/]*$', '') = regexp_replace(d.target, '/[^/]*$', '')),
imported as (
  select distinct r.*, d.target, d.target_visibility, 2 as tier from away r join (select distinct path, hint from imports_raw) i on i.path = r.path
  join defs d on r.language = d.language and r.name = d.name
  where regexp_extract(d.target, '^(.*)/[^/]*$', 1) = regexp_extract(i.hint, '([^/]*)$', 1) or ends_with(regexp_extract(d.target, '^(.*)/[^/]*$', 1), '/' || regexp_extract(i.hint, '([^/]*)$', 1))),
by_name as (
  select r.*, d.target, d.target_visibility, 3 as tier from away r join (select distinct path, name from imports_raw) i on i.path = r.path and i.name = r.name
  join defs d on r.language = d.language and r.name = d.name),
every as (select * from own union all select * from same_module union all select * from imported union all select * from by_name),
best as (select *, min(tier) over (partition by path, language, name) as first_tier, row_number() over (partition by path, language, name, tier order by target) as nth from every),
capped as (select * from best where tier = first_tier and nth <= 32),
edges as (
  select path as source, target, name as symbol, count(*) over (partition by path, language, name) > 1 as ambiguous,
    list_extract(['same_file_explicit', 'same_module', 'imported_module', 'imported_name'], tier + 1) as resolution_reason,
    case when tier = 3 then 'medium' else 'high' end as confidence, target_visibility,
    path || ':' || name || ':' || list_extract(['same_file_explicit', 'same_module', 'imported_module', 'imported_name'], tier + 1) || ':' ||
      sha256(string_agg(target, chr(0)) over (partition by path, language, name order by target rows between unbounded preceding and unbounded following)) as candidate_group,
    count(*) over (partition by path, language, name) as n_candidates
  from capped)"""
