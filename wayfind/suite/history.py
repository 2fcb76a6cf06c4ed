"""Queries over the history operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfind.catalog import register
from wayfind.functions import text as X
from wayfind.operators import history as H
from wayfind.session import table
from wayfind.settings import BUG_KEYWORDS, FIREFIGHTING_KEYWORDS, HistorySettings
from wayfind.suite.adapters import COMMITS_SQL, NOW, PATHS_SQL, commit_paths, commits

WITH = f"with {COMMITS_SQL}, {PATHS_SQL}"
SCOPE = "src/ECONOMY"
EVERY = HistorySettings(now=NOW)


def _word(text: str, words: tuple[str, ...]) -> str:
    """RE2 has no lookaround, so the bounds are part of the match."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"regexp_matches(lower({text}), '(^|{edge})({'|'.join(words)})($|{edge})')"


def _terms(text: str, words: tuple[str, ...], substring: bool = False) -> str:
    hit = (lambda k: f"contains(lower({text}), '{k}')") if substring else (lambda k: _word(text, (k,)))
    return "concat_ws(',', " + ", ".join(f"case when {hit(k)} then '{k}' end" for k in sorted(words)) + ")"


@register("churn", f"{WITH} select path, count(*)::bigint as commits from commit_paths semi join windowed using (id) group by path")
def churn(spark, d):
    """Commits of the window by changed path."""
    return H.order_paths(H.churn(commits(spark, d), commit_paths(spark, d), EVERY))


@register("churn_scoped", f"{WITH} select path, count(*)::bigint as commits from commit_paths semi join windowed using (id) where path = '{SCOPE}' or starts_with(path, '{SCOPE}/') group by path")
def churn_scoped(spark, d):
    return H.churn(commits(spark, d), commit_paths(spark, d), HistorySettings(now=NOW, scope=SCOPE))


@register("scoped_commits", f"{WITH} select id from commits where id in (select id from commit_paths where starts_with(path, '{SCOPE}/'))")
def scoped_commits(spark, d):
    return H.scoped_commits(commits(spark, d), commit_paths(spark, d), SCOPE).select("id")


TOP = 300


@register(
    "churn_rate",
    f"""{WITH}, counts as (select path, count(*)::bigint as commits from commit_paths semi join windowed using (id) group by path),
    top as (select * from counts order by commits desc, path limit {TOP}),
    sized as (select top.path, commits, case when p_partkey % 5 <> 0 then octet_length(encode(repeat(p_name, 1 + p_partkey % 9)))::bigint end as size_bytes from top
      join part on p_partkey = regexp_extract(path, '([0-9]+)$', 1)::bigint)
    select path, commits, size_bytes, commits * 1024000 // size_bytes as commits_per_kib_milli, case when size_bytes is null then 'missing_at_head' else 'text' end as size_status from sized""",
)
def churn_rate(spark, d):
    """Sizes of the most changed files at HEAD (a top-k feature) and commits by KiB."""
    path = F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey"))
    blobs = table(spark, d, "part").where("p_partkey % 5 <> 0").select(path.alias("path"), F.repeat("p_name", F.col("p_partkey").cast("int") % 9 + 1).alias("content"))
    return H.head_sizes(H.churn(commits(spark, d), commit_paths(spark, d), EVERY), blobs, EVERY, TOP)


@register("commit_counts", f"with {COMMITS_SQL} select count(*)::bigint as commits_seen, count(*) filter (not is_merge)::bigint as non_merge_commits_seen from commits")
def commit_counts(spark, d):
    return H.commit_counts(commits(spark, d))


@register("observed_range", f"with {COMMITS_SQL} select min(committer_seconds) as first_seconds, max(committer_seconds) as last_seconds from commits")
def observed_range(spark, d):
    return H.observed_range(commits(spark, d))


@register("newest_commits", f"with {COMMITS_SQL} select id, committer_seconds from commits order by committer_seconds desc, id desc limit 500")
def newest_commits(spark, d):
    """The ceiling on commits, newest first (a top-k feature)."""
    return H.collected(commits(spark, d), 500).select("id", "committer_seconds")


def _people(where: str) -> str:
    return f"""with {COMMITS_SQL}, people as (
      select 'p' || (o_custkey % 97) || '@example.com' as email, count(*)::bigint as commits, 'Person ' || (o_custkey % 97) as name from commits where not is_merge{where} group by all)
    select name, email, commits, (commits * 100 // sum(commits) over ())::int as share_percent from people"""


@register("contributors_overall", _people(""))
def contributors_overall(spark, d):
    return H.contributors(H.identities(commits(spark, d)), HistorySettings(now=NOW, include_emails=True))


@register("contributors_recent", _people(f" and author_seconds >= {NOW} - 180 * 86400"))
def contributors_recent(spark, d):
    return H.contributors(H.identities(commits(spark, d)), HistorySettings(now=NOW, include_emails=True), recent=True)


def _mailmap(spark):
    rows = [(f"Canon {k % 7}", f"canon{k % 7}@example.com", None, f"p{k}@example.com") for k in range(0, 97, 4)]
    rows += [("Special", None, "PERSON 8", "P8@EXAMPLE.com"), ("Nobody", "n@example.com", "Other Name", "p12@example.com")]
    return spark.createDataFrame(rows, "proper_name string, proper_email string, commit_name string, commit_email string")


@register(
    "identity_mappings",
    f"""with {COMMITS_SQL}, people as (select distinct o_custkey % 97 as k from commits)
    select 'Person ' || k as raw_name, 'p' || k || '@example.com' as raw_email, case when k = 8 then 'Special' else 'Canon ' || (k % 7) end as canonical_name,
      case when k = 8 then 'p8@example.com' else 'canon' || (k % 7) || '@example.com' end as canonical_email
    from people where k % 4 = 0""",
)
def identity_mappings(spark, d):
    """Raw people that a mailmap renames; an entry with name and email beats one with the email."""
    return H.identity_mappings(H.identities(commits(spark, d), _mailmap(spark)), include_emails=True)


@register("bug_paths", f"{WITH}, bugs as (select id from windowed where {_word('message', BUG_KEYWORDS)}) select path, count(*)::bigint as commits from commit_paths semi join bugs using (id) group by path")
def bug_paths(spark, d):
    return H.keyword_paths(commits(spark, d), commit_paths(spark, d), EVERY, BUG_KEYWORDS)


@register(
    "bug_overlap",
    f"""{WITH}, bugs as (select id from windowed where {_word('message', BUG_KEYWORDS)}), churned as (select distinct path from commit_paths semi join windowed using (id))
    select path, count(*)::bigint as commits from commit_paths semi join bugs using (id) semi join churned using (path) group by path""",
)
def bug_overlap(spark, d):
    c, p = commits(spark, d), commit_paths(spark, d)
    return H.bug_overlap(H.keyword_paths(c, p, EVERY, BUG_KEYWORDS), H.churn(c, p, EVERY))


def _evidence(words: tuple[str, ...]) -> str:
    return f"""{WITH}, hits as (select id, message, {_terms('message', words)} as matched_terms from windowed where {_word('message', words)})
    select id, message as subject, string_agg(path, '|' order by path) as paths, matched_terms from hits join commit_paths using (id) group by id, message, matched_terms"""


def _listed(df):
    return df.select("id", "subject", F.array_join("paths", "|").alias("paths"), F.array_join("matched_terms", ",").alias("matched_terms"))


@register("bug_evidence", _evidence(BUG_KEYWORDS))
def bug_evidence(spark, d):
    return _listed(H.evidence_commits(commits(spark, d), commit_paths(spark, d), EVERY, BUG_KEYWORDS))


@register("firefighting_commits", _evidence(FIREFIGHTING_KEYWORDS))
def firefighting_commits(spark, d):
    return _listed(H.evidence_commits(commits(spark, d), commit_paths(spark, d), EVERY, FIREFIGHTING_KEYWORDS))


@register("firefighting_paths", f"{WITH}, hits as (select id from windowed where {_word('message', FIREFIGHTING_KEYWORDS)}) select path, count(*)::bigint as commits from commit_paths semi join hits using (id) group by path")
def firefighting_paths(spark, d):
    return H.keyword_paths(commits(spark, d), commit_paths(spark, d), EVERY, FIREFIGHTING_KEYWORDS)


_MONTHS = f"with {COMMITS_SQL}, months as (select strftime(make_timestamp(author_seconds * 1000000), '%Y-%m') as month, count(*)::bigint as commits from commits group by 1)"


@register("activity_months", f"{_MONTHS} select * from months")
def activity_months(spark, d):
    return H.activity(commits(spark, d))


@register("busiest_month", f"{_MONTHS} select month, commits from months order by commits desc, month desc limit 1")
def busiest_month(spark, d):
    return H.busiest_month(H.activity(commits(spark, d)))


KEYWORDS = ("the", "la", " THAT ", "die", "", "not_there")


@register("keyword_word", f"select doc_id, {_terms('text', ('the', 'la', 'that', 'die', 'not_there'))} as terms from documents")
def keyword_word(spark, d):
    """Keywords as words in every whole text."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.matched_keywords(F.col("text"), KEYWORDS), ",").alias("terms"))


@register("keyword_substring", f"select doc_id, {_terms('text', ('the', 'la', 'that', 'die', 'not_there'), True)} as terms from documents")
def keyword_substring(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.matched_keywords(F.col("text"), KEYWORDS, substring=True), ",").alias("terms"))
