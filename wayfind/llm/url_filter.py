"""URL filters with redirect equivalence, in DataFrame expressions alone.

A rule fits a host and its subdomains where the path starts with the rule's path; the
longest rule wins. URLs that redirect to each other or name the same canonical page are
aliases: connected components over these edges. A url with a rule of its own keeps that
rule's verdict. One without takes its component's: allow if any alias is explicitly
allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.components import connected_components
from wayfind.storage import materialize

Rule = tuple[str, str, str]

#: (verdict, host, path). Rules are part of the plan; their number is the caller's.
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null.

    Length is that of host and path together; of equals the longer host, then the first in
    code point order, wins.
    """
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(len(h)).alias("h"), F.lit(f"{h}{p}").alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (r[1] + r[2], r[0]), reverse=True)
    ]
    if not fits:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    best = F.array_max(F.array_compact(F.array(*fits)))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def node_of(url: Column) -> Column:
    """A url as a node: white space trimmed, the fragment dropped, scheme and host lowered."""
    part = lambda k: F.regexp_extract(url, r"(?s)^\s*+([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*+)([^#]*+)", k)
    rest = F.rtrim(part(3), F.lit(" \t\n\x0b\f\r"))
    rest = F.when(rest == "", "/").otherwise(rest)
    return F.when(part(1) != "", F.concat(F.translate(F.concat(part(1), part(2)), _UPPER, _LOWER), rest))


def _absolute(base: Column, link: Column) -> Column:
    """A link as the page at ``base`` means it."""
    link = F.regexp_replace(F.regexp_replace(F.trim(link), "(?i)&amp;", "&"), r"[\t\n\r]", "")
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == ""), F.lit(None).cast("string"))
        .when(link.startswith("?"), F.concat(site, F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


_QUOTED = r"""(?is)\b{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*(F.regexp_extract(tag, _QUOTED.format(name), k) for k in (1, 2, 3)))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(base, link): each page's url, and its canonical links and refresh targets as written."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    # What follows the last tag end holds no whole tag, and in the rest each opening finds its end: one way through the page.
    html = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tags = F.filter(tags, lambda tag: tag.rlike("(?i)canonical|refresh"))
    tag = F.col("tag")
    rel, equiv = _attribute(tag, "rel"), _attribute(tag, "http-equiv")
    canonical = tag.rlike("(?i)^<link") & rel.rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = tag.rlike("(?i)^<meta") & equiv.rlike(r"(?i)^\s*refresh\s*$")
    target = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1)
    rows = pages.select(F.col(url_col).cast("string").alias("base"), F.explode(tags).alias("tag"))
    return rows.select("base", F.when(canonical, _attribute(tag, "href")).when(refresh, target).alias("link"))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): the node of each page's url, and of where its links lead; null where nowhere.

    The links are written first: they are few, and the expressions over them are long.
    """
    links = materialize(page_links(pages, url_col, html_col), "links")
    absolute = materialize(links.select("base", _absolute(F.col("base"), F.col("link")).alias("to")), "links")
    return absolute.select(node_of(F.col("base")).alias("u"), node_of(F.col("to")).alias("v"))


def alias_verdicts(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """(node, alias_verdict) for every url with an alias; null where no alias has a rule."""
    comp = connected_components(edges)
    ruled = comp.select("node", "component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("v"))
    of = ruled.groupBy("component").agg(F.max(F.col("v") == "allow").alias("a"), F.max(F.col("v") == "block").alias("b"))
    verdict = F.when(F.col("a"), "allow").when(F.col("b"), "block")
    return ruled.select("node", "component").join(of.select("component", verdict.alias("alias_verdict")), "component").select("node", "alias_verdict")


def judge(pages: DataFrame, rules: list[Rule] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, alias_verdict), one row for each page.

    ``redirects`` adds edges (from_url, to_url), such as a crawler's log. A null url, or one
    without ``://``, has empty host and path, fits no rule, has no alias, and is allowed.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        logged = redirects.select(node_of(F.col("from_url").cast("string")).alias("u"), node_of(F.col("to_url").cast("string")).alias("v"))
        edges = edges.unionAll(logged)
    aliases = materialize(alias_verdicts(materialize(edges, "aliases"), rules), "alias_verdicts").where("alias_verdict is not null")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("_node"))
    ruled = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    joined = ruled.join(aliases, F.col("_node") == F.col("node"), "left")
    verdict = F.coalesce(F.col("_rule")["verdict"], F.col("alias_verdict"), F.lit("allow"))
    return joined.select("page_id", "url", "host", "path", F.col("_rule")["rule"].alias("rule"), verdict.alias("verdict"), "alias_verdict")
