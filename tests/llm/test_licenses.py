import random
import time

from wayfind.llm import licenses as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_increasing_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        ys = rng.sample(range(30), rng.randint(0, 12))
        pairs = list(enumerate(ys))
        got = L.increasing(pairs)
        best = [0] * len(ys)
        for k in range(len(ys)):
            best[k] = 1 + max([best[j] for j in range(k) if ys[j] < ys[k]], default=0)
        assert len(got) == max(best, default=0) and all(a < b for (_, a), (_, b) in zip(got, got[1:], strict=False))


def test_alignment_is_valid_and_whole_where_nothing_changed():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice(b"abcdefgh" * 1) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.2]
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        assert len(got) <= lcs(a, b)
        assert L.align(a, a) == [(k, k) for k in range(len(a))]


def scan(text):
    return [(r[0], r[1], round(r[2], 2), r[3], r[4]) for r in L.Templates(L.TEMPLATES).scan(text.encode() if text is not None else None)]


def test_every_template_is_found_by_itself_in_a_text():
    filler = "of the and to in is that it was for " * 8
    for name, texts in L.TEMPLATES.items():
        for k, text in enumerate(texts):
            n = len(L.words_of(text.encode()))
            assert (name, k, 1.0, 80, 80 + n) in scan(f"{filler} {text} {filler}"), (name, k)


def test_changed_and_repeated_copies():
    text = L.TEMPLATES["MIT"][1].split()
    changed = " ".join("zzz" if k % 9 == 4 else w for k, w in enumerate(text))
    assert [r[0] for r in scan("x y z " + changed)] == ["MIT"]
    assert scan(" ".join("zzz" if k % 3 == 1 else w for k, w in enumerate(text))) == []
    twice = "Released under the MIT License.\n" * 3
    assert [(r[0], r[3]) for r in scan(twice)] == [("MIT", 0), ("MIT", 5), ("MIT", 10)]
    assert [r[0] for r in scan("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.")] == ["CC-BY-NC-4.0", "Apache-2.0"]


def test_lines_of_the_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(r["doc_id"] for r in docs.collect() if any(t[0] in r["text"] for t in L.TEMPLATES.values()))
    got = L.license_scan(docs).collect()
    assert want and sorted({r["doc_id"] for r in got}) == want and min(r["coverage"] for r in got) >= L.MIN_COVERAGE


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "Released under the MIT License.", "c"), (3, "license " * 5000, "d")], "doc_id long, text string, license string")
    assert [r["doc_id"] for r in L.license_scan(docs).collect()] == [None]
    assert L.license_scan(docs.where("false")).count() == 0
    assert scan(None) == [] and scan("the mit") == []


def brute(text):
    """Templates with a window of the text whose longest common subsequence covers enough of them."""
    words, found = L.words_of(text.encode()), set()
    for name, texts in L.TEMPLATES.items():
        for k, t in enumerate(texts):
            own = L.words_of(t.encode())
            width = len(own) + len(own) // 4 + 1
            for start in range(0, max(1, len(words) - len(own) // 2), max(1, len(own) // 12)):
                if lcs(own, words[start : start + width]) >= L.MIN_COVERAGE * len(own):
                    found.add((name, k))
                    break
    return found


def test_scan_equals_brute_force_over_all_windows():
    """Of overlapping copies the scan keeps the fullest, so what else is found must overlap one that it keeps."""
    rng = random.Random(12)
    filler = "of the and to in is that it was for on by he as at his word line text some more".split()
    pool = [(name, k, t.split()) for name, texts in L.TEMPLATES.items() for k, t in enumerate(texts) if len(t.split()) < 90]
    for n in range(40):
        name, k, words = rng.choice(pool)
        share = rng.choice([0.0, 0.05, 0.1, 0.35])
        copy = ["zz" if rng.random() < share else w for w in words]
        text = " ".join(rng.choices(filler, k=rng.randint(0, 30)) + copy + rng.choices(filler, k=rng.randint(0, 30)))
        got, want = {r[:2] for r in scan(text)}, brute(text)
        assert got <= want, (n, got, want)
        assert bool(got) == bool(want), (n, got, want)
        if share == 0:
            assert any(len(L.words_of(L.TEMPLATES[a][b].encode())) >= len(words) for a, b in got)


def test_many_copies_in_one_text_are_all_found_in_time():
    began = time.perf_counter()
    found = L.Templates(L.TEMPLATES).scan(b"All rights reserved. " * 40_000)
    assert len(found) == 40_000 and [f[3] for f in found] == list(range(0, 120_000, 3))
    assert time.perf_counter() - began < 15


def test_kept_copies_are_those_of_comparing_each_with_all():
    known, rng = L.Templates(L.TEMPLATES), random.Random(8)
    parts = [t for texts in L.TEMPLATES.values() for t in texts if len(t) < 2_000] + ["Copyright 2001 Some Body", "filler words that are none"]
    for _ in range(15):
        text = " ".join(w for t in rng.choices(parts, k=6) for w in t.split() if rng.random() > 0.02).encode()
        found = known.scan(text)
        assert all(a[4] <= b[3] for a, b in zip(found, found[1:], strict=False))
