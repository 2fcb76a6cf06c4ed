"""Queries over Merkle trees: parts are files, nations versions of the repository that they are in."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.operators import trees as T
from wayfind.session import spread, table

_FILES = """
files as (select n_nationkey as v, replace(p_type, ' ', '/') || '/' || p_brand || '/' || p_partkey as path, md5(p_partkey || case when p_partkey % 25 = n_nationkey then 'changed' else '' end) as oid
  from part, nation where p_partkey % 31 <> n_nationkey)"""


def _files(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey")
    part = spread(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    each = part.select("*", F.explode(F.lit([*range(25)])).alias("v")).join(nations, F.col("v") == F.col("n_nationkey")).where(F.col("p_partkey") % 31 != F.col("v"))
    path = F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    said = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 25 == F.col("v"), "changed").otherwise(""))
    return each.select(F.col("v").cast("string").alias("id"), path.alias("path"), F.lit("100644").alias("mode"), F.md5(said.cast("binary")).alias("oid"))


def _pairs(spark, d):
    roots, entries = T.built(_files(spark, d))
    old = roots.select((F.col("id").cast("int") + 1).cast("string").alias("_id"), F.col("tree").alias("old"))
    return roots.join(old, F.col("id") == F.col("_id"), "left").select("id", "old", F.col("tree").alias("new")), entries


@register("tree_changes", f"""with {_FILES} select coalesce(a.v, b.v + 1)::varchar as id, coalesce(a.path, b.path) as path, b.oid as before, a.oid as after
  from files a full join files b on a.v = b.v + 1 and a.path = b.path where coalesce(a.v, b.v + 1) < 25 and a.oid is distinct from b.oid""")
def tree_changes(spark, d):
    """Files that each version changed against the one before, found by going down both trees."""
    pairs, entries = _pairs(spark, d)
    return T.changed_paths(pairs, T.stored(entries), max_paths=10**9, max_nodes=10**9, max_entries=None)[0]


@register("tree_walk", f"""with {_FILES} select v::varchar as id, path, '100644' as mode, oid from files where path not like '%/PLATED/%'""")
def tree_walk(spark, d):
    """Files of every version, without folders that are pruned."""
    roots, entries = T.built(_files(spark, d))
    return T.walk(roots, T.stored(entries), prune=lambda path: F.split_part(path, F.lit("/"), F.lit(-1)) == "PLATED", max_nodes=10**9, max_entries=None)[0]


@register("tree_losses", f"""with {_FILES}, counted as (select v, count(*) as n from files where v = 3 group by v),
  diff as (select coalesce(a.v, b.v + 1) as v, coalesce(a.path, b.path) as path from files a full join files b on a.v = b.v + 1 and a.path = b.path where coalesce(a.v, b.v + 1) < 25 and a.oid is distinct from b.oid)
  select v::varchar as id, 'paths' as reason, (count(*) - 20)::bigint as n from diff group by v having count(*) > 20""")
def tree_losses(spark, d):
    """How many changed files of each version a ceiling of twenty leaves out."""
    pairs, entries = _pairs(spark, d)
    return T.changed_paths(pairs, T.stored(entries), max_paths=20, max_nodes=10**9, max_entries=None)[1]
