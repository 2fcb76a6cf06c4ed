import random

import numpy as np
import xxhash

from wayfind.llm import queries, simhash
from wayfind.llm.components import connected_components


def brute_fingerprint(text, shingle):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_fingerprints():
    for text in (None, "", " \n", "One", "Two words", "a B c", "É À x y z w", "w " * 50, "a b c d e f g A B"):
        for shingle in (3, 5):
            assert simhash.fingerprint(None if text is None else text.encode(), shingle) == brute_fingerprint(text, shingle)
    assert simhash.fingerprint(b"x y z " * 20_000, 3) == brute_fingerprint("x y z " * 20_000, 3)  # over a block


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    docs = sorted(docs, key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(r["text"], 3) for r in docs]
    comp = brute_components(fps, 2)
    got = {r["doc_id"]: r for r in queries.op7_simhash(spark, path).collect()}
    for k, r in enumerate(docs):
        assert got[r["doc_id"]]["fingerprint"] == f"{fps[k]:016x}"
        assert got[r["doc_id"]]["component_id"] == docs[comp[k]]["doc_id"]


def test_links_equal_brute_force_even_in_dense_groups(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3, 4]))) for c in centre for _ in range(90)} | {rng.getrandbits(64) for _ in range(300)}
    signed = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance in (1, 2, 3):
        want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        got = {(r["u"], r["v"]) for r in simhash.links(table, distance).collect()}
        assert got == want


def test_thresholds_of_several_bits_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(63), d)) for b in base for d in range(4)})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    halves = [(list(range(32)), 1), (list(range(32, 64)), 0)]
    monkeypatch.setattr(simhash, "plan", lambda *_: halves)
    want = {(a, b) for a in fps for b in fps if a > b and (a ^ b).bit_count() <= 2}
    assert {(r["u"], r["v"]) for r in simhash.links(table, 2).collect()} == want


def test_allocation_is_least():
    cost = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 3.0, 1: 50.0}]
    assert simhash.allocate(cost, 0) == (5.0, [-1, 1, 0])
    n, both = 100, np.eye(64) * 50
    groups = simhash.group_bits(n, both, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 180)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (200, 201), (201, 200)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 180), 100), 200: 200, 201: 200}
    assert connected_components(edges.where("false")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "alpha beta gamma delta epsilon"
    rows = [(5, a, "x"), (3, a, "y"), (3, a, "z"), (8, b, "x"), (8, c, "x"), (9, c, None), (None, a, "n"), (None, "lone words of no id at all here", "n"), (11, None, "e"), (12, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.drop_near_duplicates(docs).collect()
    assert sorted([(r["doc_id"] or -1, r["text"] or "") for r in out]) == sorted([(3, a), (8, b), (8, c), (-1, "lone words of no id at all here"), (11, "")])
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0
