import random

from wayfind.llm import similar, simhash
from wayfind.storage import materialize


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def copies(seed, groups, size, length, edits):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = []
    for _ in range(groups):
        base = [word() for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(length)] = word()
            out.append(" ".join(text))
    return out


def links(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = simhash.fingerprints(docs, 5, keys=True).selectExpr("doc_id as node", "doc_id as id", "keys")
    return {(r["u"], r["v"]) for r in similar.similar_links(materialize(signed, "test"), docs, "doc_id", "text").collect()}


def test_links_equal_brute_force(spark):
    texts = [*copies(1, 25, 4, 120, 5), "", "one two", "one two", "One TWO"]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8}
    assert want and links(spark, texts) == want


def test_a_large_group_is_one_class(spark):
    texts = copies(2, 1, 150, 200, 2) + copies(3, 5, 1, 200, 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [0, *range(150, 155)]
    signed = materialize(simhash.fingerprints(docs, 5, keys=True).selectExpr("doc_id as node", "keys"), "test")
    assert similar.candidate_pairs(signed).count() < 2 * similar.BANDS * len(texts)  # no pairs of all with all


def classes(n, pairs):
    up = list(range(n))

    def top(k):
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(n)]


def test_large_groups_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 300)  # several blocks
    rng = random.Random(11)
    base, texts = [f"w{rng.randint(0, 5000)}" for _ in range(200)], []
    for _ in range(1100):
        text = list(base)
        for _ in range(rng.randint(3, 5)):
            text[rng.randrange(200)] = f"w{rng.randint(0, 5000)}"
        texts.append(" ".join(text))
    sets = [grams(t) for t in texts]
    near = lambda x, y: (both := len(x & y)) >= 0.8 * (len(x) + len(y) - both) - 1e-9
    exact = [(a, b) for a in range(len(texts)) for b in range(a) if near(sets[a], sets[b])]
    got = links(spark, texts)
    assert got <= set(exact)
    assert classes(len(texts), got) == classes(len(texts), exact)


def test_below_the_threshold_nothing_goes(spark):
    base = [f"w{k}" for k in range(100)]
    other = [w if k % 12 else f"x{k}" for k, w in enumerate(base)]
    assert jaccard(" ".join(base), " ".join(other)) < 0.75
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs).count() == 2


def test_planted_copies_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    rare = {}
    for d, t in text.items():
        for g in sorted(grams(t), key=hash)[:20]:
            rare.setdefault(g, []).append(d)
    near = {(a, b) for ds in rare.values() if len(ds) < 40 for a in ds for b in ds if a < b and jaccard(text[a], text[b]) >= 0.8}
    assert near and not [p for p in near if p[0] in kept and p[1] in kept]
    alone = set(text) - {d for ds in rare.values() if len(ds) > 1 for d in ds}
    assert alone <= kept


def test_texts_behind_one_fingerprint_keep_their_links(spark, monkeypatch):
    """Two texts of equal fingerprints, one of them similar to a third: one text stays, whatever the ids."""
    monkeypatch.setattr(simhash, "fingerprint", lambda text, shingle, also=None: one(text, shingle, also) if b"alone" in (text or b"") else stub(text, shingle, also))
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:97], "x", "y", "z"])
    first, third = " ".join(f"v{k}" for k in range(100)), near + " alone"
    assert jaccard(near, third) >= 0.8 > jaccard(first, third)
    for ids in ((1, 2, 3), (None, 2, 3), (1, None, 3), (1, 1, 3), (None, None, 3)):
        docs = spark.createDataFrame(list(zip(ids, (first, near, third), strict=True)), "doc_id long, text string")
        assert simhash.drop_near_duplicates(docs).count() == 1, ids


one = simhash.fingerprint


def stub(text, shingle, also=None):
    """The same fingerprint for every text."""
    one(text, shingle, also)
    return 12345
