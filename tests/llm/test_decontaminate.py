import itertools
import random

import numpy as np

from wayfind.llm import decontaminate as D


def brute(words, item):
    """Whether some diagonal has a stretch that is similar and long enough."""
    best = None
    if len(item) < D.MIN_ITEM:
        return next((k for k in range(len(words) - len(item) + 1) if words[k : k + len(item)] == item), None)
    for diagonal in range(-len(item) + 1, len(words)):
        same = [words[diagonal + k] == item[k] if 0 <= diagonal + k < len(words) else None for k in range(len(item))]
        for a, b in itertools.combinations(range(len(item) + 1), 2):
            part = same[a:b]
            if None in part or b - a < min(D.MIN_OVERLAP, len(item)):
                continue
            if sum(part) * 5 >= len(part) * 4 and (best is None or sum(part) > best):
                best = sum(part)
    return best


def test_masks_meet_every_similar_run_often_enough():
    for n in range(D.MIN_ITEM, 21):
        for gaps in itertools.combinations(range(n), n // 5):
            masks = [k[1:] for k in D.kinds_of(n)]
            hits = sum(all(s + k not in gaps for k, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1))
            assert hits >= (2 if n >= D.MIN_OVERLAP else 1), gaps


def test_longest_stretch_equals_brute_force():
    rng = random.Random(8)
    for _ in range(500):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randint(0, 25))], bool)
        fits = [(b - a, -a) for a in range(len(same) + 1) for b in range(a, len(same) + 1) if 5 * same[a:b].sum() >= 4 * (b - a)]
        length, start = max(fits)
        assert D.longest_similar(same) == (-start, -start + length)


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, [rng.choice(vocabulary) for _ in range(n)]) for k, n in enumerate([15, 22, 18, 13, 12, 11, 10, 10, 9, 8, 7, 5, 2])]
    docs, want = [], set()
    for n in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if n % 2:
            k, item = rng.choice(items)
            copy = [w if rng.random() > 0.1 else "zz" for w in item][rng.randint(0, 3) :]
            at = rng.randint(0, len(words))
            words[at:at] = copy
        docs.append((n, " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in words)))
        want |= {(n, k) for k, item in items if brute(words, item) is not None}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contamination(frame, bench).collect()} == want
    assert {r["doc_id"] for r in D.drop_contaminated(frame, bench).collect()} == {n for n, _ in docs} - {n for n, _ in want}


def test_a_full_filter_finds_the_same(spark, monkeypatch):
    path = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["start_token"]) for r in df.collect())
    whole = key(D.contamination(docs, bench))
    kept = sorted(r["doc_id"] for r in D.drop_contaminated(docs, bench).collect())
    assert kept == sorted({r["doc_id"] for r in docs.collect()} - {k[0] for k in whole})
    monkeypatch.setattr(D, "MOST_FILTER_BITS", 1 << 7)
    assert key(D.contamination(docs, bench)) == whole


def test_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "a b " * 5_000), (3, "b " + "a " * 299)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a " * 300), (8, "a b " * 100)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start_token"], r["n_tokens"], r["n_matched"]) for r in D.contamination(docs, bench).collect())
    assert got == [(1, 7, 0, 300, 300), (2, 8, 0, 200, 200), (3, 7, 0, 300, 299)]


def test_planted_passages_are_found(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    flat = {r["doc_id"]: " " + " ".join(D.tokens(r["text"])[k].decode() for k in range(len(D.tokens(r["text"])))) + " " for r in docs}
    full = {(d, b["item_id"]) for b in bench.collect() for d, t in flat.items() if f" {' '.join(w.decode() for w in D.tokens(b['text']))} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.contamination(spark.createDataFrame(docs), bench).collect()}
    assert full and full <= got


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "a b c d e f g h i j", 7), (3, "a b c d e f g h i j", 8), (3, "a b c d e f g h i j", 8)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(1, "A b, c d e f g h i j!"), (2, None), (3, "a x"), (4, ""), (5, "J")], "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in got) == [(0, 1), (0, 5), (3, 1), (3, 1), (3, 5), (3, 5)]
    assert D.contamination(docs, bench.where("false")).count() == 0 and D.contamination(docs.where("false"), bench).count() == 0
    assert D.drop_contaminated(docs, bench).columns == docs.columns and D.drop_contaminated(docs, bench).count() == 2
