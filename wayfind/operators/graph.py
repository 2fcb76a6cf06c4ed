"""The lexical dependency graph over files: edges, ranking and degrees.

``symbols`` follows the schema of that name. A reference resolves by the first tier that
applies: a definition in its own file (which also ends the search), one in the same Go
package and directory, one in a module that the file imports, and last any definition of a
name that it imports. Every tier is an equi-join; whether a hint means a path is turned
into equality of keys, and a reference is joined once for all its repeats in a file.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import modules as M
from wayfind.functions import paths as P
from wayfind.functions import text as X
from wayfind.storage import bucketed, materialize, release

DAMPING, ITERATIONS = 0.85, 24
#: Up to so many files and edges a graph is ranked on the driver: within the ceilings of every
#: profile, and some tens of megabytes.
SMALL_GRAPH = 500_000
#: Symbols whose references and candidates one task takes, however many there are in all.
PART_SYMBOLS = 200_000
#: Edges of one bucket of the ranking.
PART_EDGES = 1_000_000
TEXT_FOCUS_BOOST, PATH_FOCUS_BOOST = 0.35, 0.7


def definitions(symbols: DataFrame) -> DataFrame:
    """(language, name, path, visibility): one row for each defining file, its smallest label of visibility."""
    defs = symbols.where(M.graph_definition(F.col("role"), F.col("kind")))
    return defs.groupBy("language", "name", "path").agg(F.min("visibility").alias("visibility"))


def references(symbols: DataFrame) -> DataFrame:
    """(language, name, path, seq): each graph reference of a file once, at its first place."""
    refs = symbols.where(M.graph_reference(F.col("role"), F.col("evidence"), F.col("kind"), F.col("name")))
    return refs.groupBy("language", "name", "path").agg(F.min("seq").alias("seq"))


def file_imports(symbols: DataFrame) -> DataFrame:
    """(path, name, hints) of each import."""
    found = symbols.where((F.col("role") == "definition") & (F.col("evidence") == "import"))
    return found.select("path", "name", M.import_hints(F.col("context"), F.col("language")).alias("hints"))


def module_names(symbols: DataFrame) -> DataFrame:
    """(path, modules): the sorted module names that a file defines."""
    found = symbols.where((F.col("role") == "definition") & (F.col("kind") == "module"))
    return found.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("modules"))


def _first_candidates(targets: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, found): the first ``most`` targets of each key, with their visibility.

    References to a key share them, so a name that many files define and many refer to costs their
    sum and not their product. The first of several keys' targets are among the first of each.
    """
    place = F.dense_rank().over(Window.partitionBy(*key).orderBy("target", "target_visibility"))  # cut before rows are dealt out
    rows = targets.select(*key, "target", "target_visibility").withColumn("_place", place).where(F.col("_place") <= most)
    return rows.groupBy(*key).agg(F.collect_set(F.struct("target", "target_visibility")).alias("found"))


def lexical_edges(symbols: DataFrame, max_candidates: int = 32, max_edges: int | None = None) -> DataFrame:
    """Resolved edges in the schema of that name, distinct.

    ``max_edges`` counts in scan order (path, symbol, candidate) before repeats go; None is
    no ceiling.
    """
    parts = max(int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-symbols.count() // PART_SYMBOLS))
    # Small parts would else be joined to few whose rows, packed closely, are far more in memory.
    symbol = ["language", "name", "path"]
    defs, refs = definitions(symbols.repartition(parts, *symbol)), references(symbols.repartition(parts, *symbol))
    target = defs.select("language", "name", F.col("path").alias("target"), F.col("visibility").alias("target_visibility"))
    own = refs.join(defs.select("language", "name", "path", "visibility"), ["language", "name", "path"])
    itself = F.array(F.struct(F.col("path").alias("target"), F.col("visibility").alias("target_visibility")))
    found = lambda rows, tier: rows.select("language", "name", "path", "seq", "found", F.lit(tier).alias("tier"))
    same_file = found(own.withColumn("found", itself), 0)
    away = refs.join(defs.select("language", "name", "path"), ["language", "name", "path"], "left_anti")

    modules = module_names(symbols)
    directory = lambda c: P.parent(F.col(c), "")
    modules = modules.select("path", F.explode("modules").alias("module"))
    here = away.where("language = 'go'").join(modules, "path").withColumn("dir", directory("path"))
    there = target.where("language = 'go'").join(modules.withColumnRenamed("path", "target"), "target").withColumn("dir", directory("target"))
    place = ["language", "name", "dir", "module"]
    same_module = found(here.join(_first_candidates(there, place, max_candidates), place), 1)

    imports = materialize(file_imports(symbols), "imports", compact=True)  # its expressions are long, its rows few
    wanted = imports.select("path", F.explode("hints").alias("hint")).select("path", F.explode(M.hint_keys(F.col("hint"))).alias("k")).select("path", "k.kind", "k.key").distinct()
    hinted = away.join(wanted, "path")
    asked = hinted.select("language", "name").distinct()  # only what an importing file refers to is spread by its keys
    wanted_defs = target.join(asked, ["language", "name"], "left_semi")
    keys = wanted_defs.select("target").distinct().select("target", F.explode(M.path_keys(F.col("target"))).alias("k")).select("target", "k.kind", "k.key")
    keys = keys.join(wanted.select("kind", "key").distinct(), ["kind", "key"], "left_semi")  # most endings of paths are no one's hint
    keyed = wanted_defs.join(keys, "target")
    means = ["language", "name", "kind", "key"]
    imported = found(hinted.repartition(parts, *means).join(_first_candidates(keyed, means, max_candidates), means), 2)

    named = away.join(imports.select("path", "name").distinct(), ["path", "name"], "left_semi")
    sought = target.join(named.select("language", "name").distinct(), ["language", "name"], "left_semi")
    by_name = found(named.join(_first_candidates(sought, ["language", "name"], max_candidates), ["language", "name"]), 3)

    every = same_file.unionByName(same_module).unionByName(imported).unionByName(by_name).repartition(parts, "path", "name")
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, max_candidates)
    tiers = every.groupBy("path", "language", "name", "tier").agg(F.min("seq").alias("seq"), merged.alias("found"))
    first = tiers.groupBy("path", "language", "name").agg(F.min_by(F.struct("tier", "seq", "found"), "tier").alias("b")).select("path", "name", "b.*")
    reason = F.element_at(F.array(*map(F.lit, ("same_file_explicit", "same_module", "imported_module", "imported_name"))), F.col("tier") + 1)
    listed = F.transform("found", lambda c: c["target"])
    resolved = first.select(
        F.col("path").alias("source"), F.col("name").alias("symbol"), "seq", (F.size("found") > 1).alias("ambiguous"), listed.alias("candidates"), "found",
        reason.alias("resolution_reason"), F.when(F.col("tier") == 3, "medium").otherwise("high").alias("confidence"),
    ).where(F.size("found") > 0)
    group = F.concat_ws(":", "source", "symbol", "resolution_reason", X.digest(F.col("candidates")))
    resolved = resolved.withColumn("candidate_group", group)
    if max_edges is None:  # repeats, of a file in two languages, go before the candidates are spread
        one = [F.first(c).alias(c) for c in ("ambiguous", "candidates", "resolution_reason", "confidence")]
        resolved = resolved.groupBy("source", "symbol", "candidate_group").agg(*one, F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    rows = resolved.select("*", F.posexplode("found").alias("nth", "c"))
    if max_edges is not None:
        rows = rows.orderBy("source", "seq", "nth").limit(max_edges)
    rows = rows.select(
        "source", F.col("c.target").alias("target"), "symbol", "ambiguous", "candidates", "candidate_group", "resolution_reason", "confidence",
        F.col("c.target_visibility").alias("target_visibility"),
    )
    return rows if max_edges is None else rows.distinct()


def weighted_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", M.edge_weight(F.col("symbol"), F.col("confidence"), F.col("target_visibility")))


def degrees(edges: DataFrame) -> DataFrame:
    """(path, in_degree, out_degree, links)."""
    ends = edges.select(F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    out = ends.groupBy("path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("links", F.col("in_degree") + F.col("out_degree"))


def reference_counts(edges: DataFrame) -> DataFrame:
    """(path, name, references): how often a target's symbol is used."""
    return edges.groupBy(F.col("target").alias("path"), F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("references"))


def ambiguity_groups(edges: DataFrame) -> DataFrame:
    """One row for each group of candidates of an ambiguous reference."""
    return edges.where("ambiguous").groupBy("candidate_group").agg(
        F.min("source").alias("path"), F.min("symbol").alias("symbol"), F.max(F.size("candidates")).cast("long").alias("candidates")
    )


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, small: int | None = None) -> DataFrame:
    """(path, rank): weighted PageRank from a uniform start, so many passes exactly.

    ``edges`` has source, target and weight; parallel and self edges count, edges from or
    to paths outside ``nodes`` do not. Files without an outgoing edge spread their rank over all files. A pass is one join and one aggregation:
    parallel edges are summed before and lie in buckets of their source, the sum over files without
    edges is part of the same plan, and the small table of ranks is written after each pass. A graph of at most ``small`` files and edges
    (None: ``SMALL_GRAPH``) is ranked on the driver, with the same result.
    """
    small = SMALL_GRAPH if small is None else small
    nodes = materialize(nodes.select("path").distinct(), "nodes")
    summed = edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    inside = summed.join(nodes.withColumnRenamed("path", "target"), "target", "left_semi").join(nodes.withColumnRenamed("path", "source"), "source", "left_semi")
    summed = materialize(inside, "summed")
    n, m = nodes.count(), summed.count()
    if not n:
        return nodes.select("path", F.lit(0.0).alias("rank"))
    out = summed.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("_total"))
    share = summed.join(out, F.col("source") == F.col("_s")).select("source", "target", (F.col("weight") / F.col("_total")).alias("share"))
    if n <= small and m <= small:
        return _small_page_rank(nodes, share, iterations, damping)
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m // PART_EDGES))
    leads = out.select("_s", F.lit(True).alias("leads"))
    nodes = materialize(nodes.join(leads, F.col("path") == F.col("_s"), "left").select("path", F.coalesce("leads", F.lit(False)).alias("leads")), "nodes", compact=True)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    with bucketed(share, "source", parts, "shares") as share:
        release(summed)
        for _ in range(iterations):
            # Ranks come to the edges of their bucket, which are neither dealt out nor sorted again.
            flow = share.join(ranks.select("path", "rank").hint("shuffle_hash"), F.col("source") == F.col("path")).select("target", (F.col("share") * F.col("rank")).alias("got"))
            got = flow.groupBy("target").agg(F.sum("got").alias("got"))
            lost = ranks.where(~F.col("leads")).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
            last, ranks = ranks, materialize(nodes.join(got, F.col("path") == F.col("target"), "left").join(F.broadcast(lost)).select("path", "leads", rank.alias("rank")), "ranks", compact=True)  # lost is one row
            release(last)
    return ranks.select("path", "rank")


def _small_page_rank(nodes: DataFrame, share: DataFrame, iterations: int, damping: float) -> DataFrame:
    """The same passes over a graph whose size has been checked, without a job for each."""
    paths = sorted(r["path"] for r in nodes.collect())
    at, n = {p: k for k, p in enumerate(paths)}, len(paths)
    edges = share.toArrow()
    source, target = (np.fromiter((at.get(x, -1) for x in edges[c].to_pylist()), np.int64) for c in ("source", "target"))
    known = (source >= 0) & (target >= 0)
    source, target, weight = source[known], target[known], edges["share"].to_numpy()[known]
    leads = np.zeros(n, bool)
    leads[source] = True
    rank = np.full(n, 1.0 / n)
    for _ in range(iterations):
        got = np.bincount(target, weight * rank[source], n)
        rank = (1 - damping) / n + damping * (got + rank[~leads].sum() / n)
    return nodes.sparkSession.createDataFrame(list(zip(paths, rank.tolist(), strict=True)), "path string, rank double")


def focus_terms(focuses: tuple[str, ...]) -> list[str]:
    """Terms as they are sought: without white space around, in small letters, as often as they are named."""
    return [f.strip().lower() for f in focuses if f.strip()]


def _held(terms: list[str], *columns: str) -> Column:
    """The places in ``terms`` of those that one of the columns holds, any number of them."""
    named = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(terms))) if terms else F.array().cast("array<struct<k:int,t:string>>")

    def places(texts: Column) -> Column:
        return F.transform(F.filter(named, lambda x: F.exists(texts, lambda text: F.contains(text, x["t"]))), lambda x: x["k"])

    # The texts are bound to a variable: they are put in small letters once and not for every term.
    return F.flatten(F.transform(F.array(F.array(*(F.lower(F.coalesce(c, F.lit(""))) for c in columns))), places))


def focus_matches(symbols: DataFrame, files: DataFrame, focuses: tuple[str, ...], focus_paths: tuple[str, ...]) -> DataFrame:
    """(path, text_matches, path_match): focus terms that a file's path or a symbol holds, and whether a focus path includes it."""
    terms = focus_terms(focuses)
    base = files.select("path", P.focus_includes(F.col("path"), focus_paths).alias("path_match"))
    in_path = files.select("path", F.explode(_held(terms, "path")).alias("term"))
    in_symbols = symbols.select("path", F.explode(_held(terms, "name", "context")).alias("term"))
    found = in_path.unionAll(in_symbols).distinct().groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("text_matches"))
    return base.join(found, "path", "left").select("path", F.coalesce("text_matches", F.lit(0)).alias("text_matches"), "path_match")


def file_ranking(ranks: DataFrame, matches: DataFrame) -> DataFrame:
    """(path, score, focus_matches): the rank in millionths with its boosts, best first."""
    joined = ranks.join(matches, "path", "left").na.fill({"text_matches": 0, "path_match": False})
    score = F.col("rank") + TEXT_FOCUS_BOOST * F.col("text_matches") + PATH_FOCUS_BOOST * F.col("path_match").cast("int")
    total = F.col("text_matches") + F.col("path_match").cast("int")
    return joined.select("path", X.scaled_score(score).alias("score"), total.cast("int").alias("focus_matches")).orderBy(F.col("score").desc(), "path")


def snippet_scores(symbols: DataFrame, ranking: DataFrame, counts: DataFrame, focuses: tuple[str, ...] = ()) -> DataFrame:
    """Definitions with their score: the file's, 1,000 for each use, 250,000 for each focus."""
    defs = symbols.where("role = 'definition'")
    hits = F.size(_held(focus_terms(focuses), "name", "context")).cast("long")
    joined = defs.join(ranking.select("path", F.col("score").alias("file_score")), "path", "left").join(counts, ["path", "name"], "left")
    score = F.coalesce("file_score", F.lit(0)) + F.coalesce("references", F.lit(0)) * 1_000 + hits * 250_000
    return joined.withColumn("score", score.cast("long")).drop("file_score", "references")


def first_per_order(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in a total order, as a top-k and not as one global window."""
    return rows.orderBy(*order).limit(most)


def per_file_cap(symbols: DataFrame, most: int) -> DataFrame:
    """At most so many symbols of each file, the first in order."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq"))
    return symbols.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
