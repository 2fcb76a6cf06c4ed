import itertools
import math

import numpy as np

from wayfind.llm import language_crf as L
from wayfind.llm import queries


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for labels, sizes in ((2, [1, 4, 6]), (3, [5, 1, 3])):
        scores, trans = rng.normal(size=(sum(sizes), labels)), rng.normal(size=(labels, labels))
        starts = np.cumsum([0, *sizes[:-1]])
        got = L.marginals(scores, starts, trans)
        for start, n in zip(starts, sizes, strict=True):
            total = np.zeros((n, labels))
            for path in itertools.product(range(labels), repeat=n):
                w = math.exp(sum(scores[start + k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
                for k, y in enumerate(path):
                    # The first word is entered from every label alike.
                    total[k, y] += w * np.exp(trans[:, path[0]]).sum()
            np.testing.assert_allclose(got[start : start + n], total / total.sum(1, keepdims=True), rtol=1e-9)


def test_expected_transitions_equal_enumeration():
    rng = np.random.default_rng(4)
    scores, trans = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    node, moves = L._expected(scores, trans)
    want_node, want_moves = np.zeros_like(node), np.zeros_like(moves)
    for c in range(2):
        weights = {path: math.exp(sum(scores[c, k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))) for path in itertools.product(range(3), repeat=4)}
        for path, w in weights.items():
            for k, y in enumerate(path):
                want_node[c, k, y] += w / sum(weights.values())
            for a, b in itertools.pairwise(path):
                want_moves[a, b] += w / sum(weights.values())
    np.testing.assert_allclose(node, want_node, rtol=1e-9)
    np.testing.assert_allclose(moves, want_moves, rtol=1e-9)


def test_blocks_do_not_show(monkeypatch):
    rng = np.random.default_rng(5)
    scores, trans, starts = rng.normal(size=(500, 4)), rng.normal(size=(4, 4)), np.array([0, 1, 33, 300])
    whole = L.marginals(scores, starts, trans)
    monkeypatch.setattr(L, "BLOCK", 7)
    np.testing.assert_allclose(L.marginals(scores, starts, trans), whole, rtol=1e-9)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, path).collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and 0.15 * len(rows) < len(out) < 0.35 * len(rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_words():
    texts = [("the cat and the house were with that dog of this", "en")] * 8 + [("le chat et la maison sont avec ce chien de cette", "fr")] * 8
    model = L.fit(texts)
    words = "the cat and the house la maison et le chat".split()
    p = L.marginals(model.score_types(words), np.array([0]), model.trans)
    assert [model.labels[k] for k in p.argmax(1)] == ["en"] * 5 + ["fr"] * 5
    assert L.predict_batch([" ".join(words)], L.WordScores(model))[0][2][0] > 0.3


def test_words():
    assert L.words_of("Hello, WORLD!! x1y 123 --- don't") == ["hello", "world", "xy", "dont"]
    assert L.words_of("Été 日本 ### ça%%") == ["été", "日本", "ça"] and L.words_of(None) == []


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "x"), (2, "123 !!", "en", "x"), (None, "the cat", "en", "x"), (3, "le chat " * 9000, "fr", "x"), (3, "le chat", None, "x")], "doc_id long, text string, lang string, score string")
    model = L.train(docs)
    got = {(r["doc_id"], i): r for i, r in enumerate(L.predict(docs, model).collect())}
    assert len(got) == 5 and sorted(r["lang_pred"] for r in got.values()).count("und") == 2
    assert L.train(docs.where("lang is null")) is None
    assert [r["lang_pred"] for r in L.predict(docs, None).collect()] == ["und"] * 5
    assert L.predict(docs.where("false"), model).count() == 0
    one = L.fit([("a b", "en")])
    assert L.predict_batch(["zzz"], L.WordScores(one))[0][:2] == ("en", 1.0)


def test_every_letter_of_a_long_run_is_read():
    run = "".join(chr(0x4E00 + k % 500) for k in range(1000))
    assert "".join(L.words_of(f"x {run} y")) == f"x{run}y" and max(map(len, L.words_of(run))) == L.LONGEST
    texts = [("ab" * 400, "one"), ("cd" * 400, "two")] * 4
    scores = L.WordScores(L.fit(texts))
    assert L.predict_batch(["ab" * 12 + "cd" * 500 + "ab" * 12], scores)[0][0] == "two"


def test_words_keep_their_scores_in_any_batch(monkeypatch):
    model = L.fit([("the cat and the house", "en"), ("le chat et la maison", "fr")] * 4)
    words = "the cat le chat und was the house la maison".split()
    scores = L.WordScores(model)
    whole = scores.of(words)
    np.testing.assert_array_equal(scores.of(words[::-1]), whole[::-1])
    monkeypatch.setattr(L, "KEPT_WORDS", 3)
    again = L.WordScores(model)
    np.testing.assert_array_equal(np.concatenate([again.of(words[:4]), again.of(words[4:])]), whole)


def test_lexicons_have_the_words_of_several_documents():
    docs = [(0, ["the", "cat"]), (0, ["the", "no"]), (0, ["the", "no", "the"]), (1, ["no"]), (1, ["no", "si"]), (1, ["no", "si"]), (0, ["no"])]
    found = L.lexicons(docs)
    assert set(found) == {"the", "no"} and found["the"] != found["no"]


def test_training_with_repeated_ids_and_long_texts(spark):
    rows = [(5, "the cat and the house", "en"), (5, "le chat et la maison", "fr")] * 2000 + [(5, "the dog " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, sample_docs=100)
    assert model.labels in (["en", "fr"], ["en"], ["fr"])
    distinct = spark.createDataFrame([(None, f"the cat and the house {k}", "en") for k in range(1500)] + [(None, f"le chat et la maison {k}", "fr") for k in range(1500)], "doc_id long, text string, lang string")
    model = L.train(distinct, sample_docs=100)
    assert [r["lang_pred"] for r in L.predict(spark.createDataFrame([(1, "the house"), (2, "la maison")], "doc_id long, text string"), model).orderBy("doc_id").collect()] == ["en", "fr"]
