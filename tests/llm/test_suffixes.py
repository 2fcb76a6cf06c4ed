import hashlib
import random

import numpy as np
import pytest

from wayfind.llm import suffixes

COLUMNS = "doc_id long, text string"


def cut_slowly(docs, n):
    """By id: n_bytes, spans and bytes left, by comparison of every stretch with every earlier one."""
    first = {}
    for doc, text in docs:
        data = (text or "").encode()
        for k in range(len(data) - n + 1):
            if doc is not None:
                w = data[k : k + n]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - n + 1):
            if doc is not None and first[data[k : k + n]] < doc:
                gone[k : k + n] = b"\1" * n
        edges = [k for k in range(len(data) + 1) if (k < len(data) and gone[k]) != (k > 0 and gone[k - 1])]
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((doc, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(found):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found.collect()), key=repr)


def texts(seed, n_docs, size):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcd é") for _ in range(rnd.randint(20, 120))) for _ in range(8)]
    docs = []
    for doc in range(n_docs):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh ß") for _ in range(rnd.randint(0, size))) for _ in range(rnd.randint(0, 6))]
        docs.append((doc * 3 % n_docs, "".join(parts)))
    return docs


def test_transform_gives_the_least_document_of_each_window():
    rnd = random.Random(1)
    for n in (8, 9, 17):
        for _ in range(40):
            strings = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(n, 60))) for _ in range(rnd.randint(1, 12))]
            docs = np.array([rnd.randint(0, 5) for _ in strings])
            least = {}
            for s, d in zip(strings, docs.tolist(), strict=True):
                for k in range(len(s) - n + 1):
                    least[s[k : k + n]] = min(least.get(s[k : k + n], 9), d)
            want = [(i, k, least[s[k : k + n]]) for i, s in enumerate(strings) for k in range(len(s) - n + 1)]
            assert list(zip(*(x.tolist() for x in suffixes.least_documents(strings, docs, n)), strict=True)) == want


def test_large_transforms_sort_without_packing(monkeypatch):
    data = np.frombuffer(b"".join(bytes([65 + k % 3, 65 + k % 7]) * 5 + b"\xff" for k in range(100)), np.uint8)
    order = suffixes.suffix_order(np.tile(data, 2000), 16)  # above 2 ** 21 bytes
    tiled = np.tile(data, 2000).tobytes()
    keys = [tiled[p : p + 16].ljust(16, b"\xff") for p in order[::5000].tolist()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("n", [8, 20, 50])
def test_runs_cover_every_window_once_and_depend_on_its_bytes_alone(monkeypatch, n):
    monkeypatch.setattr(suffixes, "MAX_RUN", 7)
    rnd = random.Random(2)
    docs = [bytes(rnd.choice(b"abc") for _ in range(rnd.choice([0, 3, n - 1, n, n + 1, 30, 200]))) for _ in range(9)] + [b"ab" * 100]
    for block in (40, 1000):
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
        seen, by_bytes = {}, {}
        for pieces in suffixes.blocks(enumerate(docs), n):
            for piece, place, windows, anchor in zip(*(x.tolist() for x in suffixes.runs(pieces, n)), strict=True):
                for k in range(place, place + windows):
                    at = pieces[piece][0], pieces[piece][1] + k
                    assert at not in seen
                    seen[at] = anchor
        assert set(seen) == {(i, k) for i, d in enumerate(docs) for k in range(len(d) - n + 1)}
        for (i, k), anchor in seen.items():
            assert by_bytes.setdefault(docs[i][k : k + n], anchor) == anchor


@pytest.mark.parametrize("n", [8, 50])
def test_equals_brute_force(spark, n):
    docs = texts(n, 60, 150)
    assert got(suffixes.remove_repeats(spark.createDataFrame(docs, COLUMNS).repartition(5), n)) == cut_slowly(docs, n)


def test_hot_anchors_split_into_windows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_RUNS", 2)
    docs = texts(5, 40, 150)
    assert got(suffixes.remove_repeats(spark.createDataFrame(docs, COLUMNS), 20)) == cut_slowly(docs, 20)


def test_nulls_ties_repeats_and_short_texts(spark):
    same = "the very same words, said once more and then again, to the end"
    docs = [(1, same), (1, same), (2, same + "!"), (None, same), (3, None), (4, ""), (5, "short"), (6, "x" * 49), (7, "x" * 50), (8, "x" * 120), (9, "é" * 25), (10, "é" * 26)]
    assert got(suffixes.remove_repeats(spark.createDataFrame(docs, COLUMNS))) == cut_slowly(docs, 50)


def test_long_and_periodic_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1000)
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(20_000))
    docs = [(1, long), (2, "x" + long[5_000:9_000] + "y" * 3_000), (3, "y" * 700 + "be " * 900), (4, "e be " + "be " * 400)]
    assert got(suffixes.remove_repeats(spark.createDataFrame(docs, COLUMNS))) == cut_slowly(docs, 50)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert suffixes.remove_repeats(empty).collect() == []
    docs = spark.createDataFrame([(1, "a" * 60, 1, 2), (2, "a" * 70, 1, 2)], "doc_id int, text string, row int, batch int")
    assert got(suffixes.remove_repeats(docs)) == [(1, 60, [], b"a" * 60), (2, 70, [(0, 70)], b"")]
    assert hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        suffixes.gram_of(7)
