import re
from collections import Counter

import numpy as np

from tests.compare import SF, connection, rows

from wayfind.llm import quality, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")

def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed

TEXTS = [None, "", " \n\t ", "one", "a b c d e a b c d e f g h", "x\nx\n\nx y\nx y\n", "é ü 日本 🙂 # * $ % & | < >", "a b c d e f " * 30, "a b c d e f g h i j k", "line\r\nline\r\n", "w\x0bv\x0cu"]

def test_counts_equal_brute_force():
    for text in TEXTS:
        n, chars, symbols, dup, repeats, _ = quality.base_counts(None if text is None else text.encode())
        assert (n, chars, symbols, dup, repeats, quality.base_failed(n, repeats)) == brute(text), text

def test_query_counts_equal_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in queries.op2_quality_rules(spark, path).collect():
        want = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])

def test_distance():
    assert quality.js_distance(np.array([1, 0]), np.array([0, 1])) == 1.0
    assert quality.js_distance(np.array([2, 2]), np.array([5, 5])) == 0.0
    assert quality.js_distance(np.array([0, 0]), np.array([5, 5])) == 0.0

def test_junk_goes_and_clean_text_stays(spark):
    path = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality_rules(spark, path).collect() if r["doc_id"] in labels and not r["base_failed"] and r["n_words"] >= 80]
    clean, junk = ([r["kept"] for r in rows if labels[r["doc_id"]] == q] for q in (1, 0))
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)

def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (2, "", "en", "x"), (2, "", "en", "x"), (None, "word " * 20, "xx", None), (4, "the cat and the dog were in a house by " * 3, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = quality.quality_scores(docs).collect()
    assert len(got) == 5
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_scores(docs.where("false")).count() == 0 and quality.keep_good(docs.where("false")).count() == 0

def test_query_equals_sql(spark):
    assert rows(queries.op2_quality_rules(spark, SF).toPandas()) == rows(connection().sql(queries.OP2_SQL).df())
