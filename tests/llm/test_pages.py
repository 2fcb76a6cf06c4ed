import hashlib
import re
import time

import duckdb
from pyspark.sql import functions as F

from tests.compare import SF, connection, rows
from wayfind import storage
from wayfind.llm import queries, url_filter, warc

PAGES = "page_id long, url string, html string, first_id long"


def test_queries_equal_sql(spark):
    con = connection()
    for name in ("op8_url_filter", "op10_warc_revisits"):
        assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())


def resolved(spark, pages):
    path = storage.scratch_path(spark, "test")
    warc.write_archives(pages, path)
    return path, sorted(map(tuple, warc.resolve(warc.read_archives(spark, path)).collect()), key=repr)


def test_revisits(spark):
    big, tricky = "x" * 120, "y" * 90 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\né🙂"
    data = [(5, "http://a/", big, 1), (3, "http://b/\r\nX: y", big, 1), (9, None, big, 1), (4, "u", "small", 1), (2, "u", "small", 1), (7, "t", tricky, 1), (8, "t", tricky, 1), (1, "n", None, 1), (None, "z", big, 1)]
    pages = spark.createDataFrame(data, PAGES)
    path, got = resolved(spark, pages)
    want = []
    for page_id, _, html, _ in data:
        payload = (html or "").encode()
        first = min((d[0] for d in data if d[2] == html and d[0] is not None), default=None)
        revisit = len(payload) >= 100 and page_id != first
        want.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    stored = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert stored == {3: big, 4: "small", 2: "small", 7: tricky, 1: ""}


def test_headers_and_ids_of_any_type(spark):
    big = "x" * 120
    pages = spark.createDataFrame([("a b/é>", "http://a/", big), ("zz", "http://z/", big), ("null", "u", "s"), (None, "v", "s")], "page_id string, url string, html string")
    path = storage.scratch_path(spark, "test")
    warc.write_archives(pages, path, date="2020-01-02T03:04:05Z")
    read = warc.read_archives(spark, path, "string")
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in read.collect()} == {("a b/é>", "response", None), ("zz", "revisit", "a b/é>"), ("null", "response", None), (None, "response", None)}
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert text.count("WARC-Date: 2020-01-02T03:04:05Z") == 4 and "WARC-Refers-To-Target-URI: http://a/" in text and "WARC-Refers-To-Date: 2020-01-02T03:04:05Z" in text


def test_pieces_that_end_like_separators(spark):
    texts = ["y" * 100 + end for end in ("\r\n", "\r\n\r", "\r\n\r\n", "\r", "\n", "\r\n\r\n\r\n\r\n", "\r\r\n\r\n")] + ["\r\n\r\n" * 200, "", "\r\n"]
    pages = spark.createDataFrame([(k, "u", t, 0) for k, t in enumerate(texts)], PAGES)
    path, got = resolved(spark, pages.coalesce(1))
    assert [(g[0], g[2]) for g in sorted(got)] == [(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(texts)]
    stream, data, out = warc.RecordStream(), b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, []
    for k in range(len(data)):
        out += stream.feed(data[k : k + 1])
    stream.close()
    assert [b for _, b in out] == [b"abc"] * 3


def test_repeated_rows_and_empty_table(spark):
    big = "z" * 200
    pages = spark.createDataFrame([(1, "a", big, 1), (1, "a", big, 1), (2, "b", big, 1)], PAGES)
    _, got = resolved(spark, pages)
    assert [(g[0], g[3], g[4]) for g in got] == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert resolved(spark, pages.where("false"))[1] == []


def brute(pages, rules, redirects=()):
    def split(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    node = url_filter_node
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for u, v in redirects:
        if node(u) and node(v):
            group[find(node(u))] = find(node(v))
    said = {}
    for n in list(group):
        said.setdefault(find(n), set()).add(rule(*split(n))[1])
    out = {}
    for page_id, url in pages:
        host, path = split(url)
        text, verdict = rule(host, path)
        if verdict is None:
            near = said.get(find(node(url)), set()) if node(url) in group else set()
            verdict = "allow" if "allow" in near else "block" if "block" in near else "allow"
        out[page_id] = (host, path, text, verdict)
    return out


def url_filter_node(url):
    m = re.match(r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)([^#]*?)\s*(?:#.*)?$", url or "")
    return (m[1] + m[2]).lower() + (m[3] or "/") if m else None


def test_aliases_and_precedence(spark):
    pages = [
        (1, "https://bad.net/es/x"), (2, "https://alias.org/a#f"), (3, "http://ALIAS.org/b"), (4, "https://www.example.com/en/1"), (5, "https://m.example.com/en/1"), (6, "https://far.org/q?x=1"),
        (7, None), (8, "no scheme"), (9, "https://x.org"), (10, "https://sub.www.example.com/en/z"), (11, "ftp://a.com/"), (12, "https://mixed.org/1"), (13, "https://lone.org/"), (13, "https://lone.org/"),
    ]
    html = {
        2: "<LINK href='https://bad.net/es/x' REL=\"canonical\">", 3: '<meta http-equiv="Refresh" content="0; URL=/a">', 6: '<link rel="alternate canonical" href="//alias.org/b">',
        9: '<link rel="canonical" href="">', 12: '<link rel=canonical href="https://www.example.com/en/1"><meta http-equiv=refresh content="3;url=https://bad.net/es/x">',
    }
    edges = [(pages[1][1], pages[0][1]), (pages[2][1], "http://ALIAS.org/a"), ("https://alias.org/b", pages[5][1]), (pages[11][1], pages[3][1]), (pages[11][1], pages[0][1])]
    frame = spark.createDataFrame([(k, u, html.get(k), 0) for k, u in pages], PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(frame).collect()}
    assert got == brute(pages, url_filter.RULES, edges)
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    assert {r[0]: r[1:5] for r in con.sql(queries.OP8_SQL).fetchall()} == got
    assert got[1][3] == "block" and got[12][3] == "allow" and got[5][3] == "block" and got[10][3] == "allow"
    assert url_filter.judge(frame).count() == len(pages) and url_filter.judge(frame.where("false")).count() == 0
    block_alias = [p for p in pages if p[0] in (1, 2)]
    two = frame.where("page_id in (1, 2)")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(two).collect()} == {1: "block", 2: "block"} and len(block_alias) == 2
    log = spark.createDataFrame([("https://lone.org/", "https://bad.net/fr/"), (None, "x")], "from_url string, to_url string")
    assert {r["verdict"] for r in url_filter.judge(frame.where("page_id = 13"), redirects=log).collect()} == {"block"}


def test_broken_tags_cost_one_way_through_the_page(spark):
    """Unclosed tags, quotes and white space by the megabyte; what is whole before them still counts."""
    head = '<link rel="canonical" href="http://b/x">'
    pages = [
        (1, "http://a/1", head + "<link " * 170_000, 0), (2, "http://a/2", "<meta http-equiv=refresh " * 40_000, 0), (3, "http://a/3", "<link " * 100_000 + ">", 0),
        (4, "http://a/4" + " " * 200_000 + "x", head + "<link rel='" * 90_000, 0), (5, "http://a/5 \n", "<" * 1_000_000, 0),
    ]
    began = time.perf_counter()
    got = {r.base: r.link for r in url_filter.page_links(spark.createDataFrame(pages, PAGES)).where("link is not null").collect()}
    assert got == {"http://a/1": "http://b/x", pages[3][1]: "http://b/x"}
    nodes = [r[0] for r in spark.createDataFrame(pages, PAGES).orderBy("page_id").select(url_filter.node_of(F.col("url"))).collect()]
    assert nodes == ["http://a/1", "http://a/2", "http://a/3", pages[3][1], "http://a/5"]
    assert time.perf_counter() - began < 60
