import hashlib
import random

import pytest

from wayfind.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string"


def slowly(conversations):
    """Nodes of a dict of conv_id to its list of (role, text)."""
    nodes = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for path, members in nodes.items():
        inside = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in inside if len(p) == len(path) + 1]
        leaves = [p for p in inside if not any(q[:-1] == p for q in inside if q)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in inside if p)
        ends = sorted(c for c in members if len(conversations[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


def got(spark, conversations, turnless=()):
    rows = [(c, k, *t) for c, turns in conversations.items() for k, t in enumerate(turns)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, COLUMNS).repartition(3))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in conversations.items()], "conv_id long, length long")
    found = trie.prefix_trie(turns, lengths).collect()
    order = [(r.enters, r) for r in found]
    assert len({e for e, _ in order}) == len(order)
    for (_, a), (_, b) in zip(sorted(order), sorted(order)[1:], strict=False):  # depth first
        assert b.depth <= a.depth + 1
    return sorted(((*r[:8],) for r in found), key=repr)


def random_conversations(seed, n, longest, words="ab"):
    rnd = random.Random(seed)
    return {c: [(rnd.choice(["user", "bot"]), rnd.choice(words)) for _ in range(rnd.randint(0, longest))] for c in rnd.sample(range(-50, 500), n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_slow_trie(spark, seed):
    conversations = random_conversations(seed, 40, 5)
    assert got(spark, conversations) == slowly(conversations)


def test_long_conversations_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "PREFIX", 3)
    monkeypatch.setattr(trie, "BLOCK", 4)
    base = [("user", f"t{k}") for k in range(40)]
    conversations = {9: base, 3: base[:31] + [("user", "x")] * 5, 5: base[:31], 20: base, 1: base[:12] + base, 2: [], 7: base[:3]}
    assert got(spark, conversations) == slowly(conversations)


def test_pieces_of_ends_are_one_list(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    conversations = {c: [("user", "same")] for c in range(95, 130)}
    assert got(spark, conversations) == slowly(conversations)


def test_nulls_ties_and_rows_without_conversation(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (None, 0, "user", "lost"), (2, 5, "b", "y"), (2, 5, "a", "z"), (3, 1, "ab", "c"), (4, 1, "a", "bc")]
    found = {(r.conv_id, r.place): r for r in trie.ordered_turns(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert set(found) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (4, 0)}
    assert [found[1, k].tokens for k in range(3)] == [5, 0, 0] and found[1, 1].said == found[1, 2].said
    assert found[2, 0].said == trie.ordered_turns(spark.createDataFrame([(8, 1, "a", "z")], COLUMNS)).first().said
    assert found[3, 0].said != found[4, 0].said


def test_no_conversations_and_only_empty_ones(spark):
    turns = trie.ordered_turns(spark.createDataFrame([], COLUMNS))
    lengths = "conv_id long, length long"
    assert trie.prefix_trie(turns, spark.createDataFrame([], lengths)).collect() == []
    only = trie.prefix_trie(turns, spark.createDataFrame([(4, 0), (2, 0)], lengths)).collect()
    assert [tuple(r[:7]) for r in only] == [(2, 0, None, 2, 0, 1, 0)]
    assert only[0].ends_sha256 == hashlib.sha256(b"2,4").hexdigest()


def test_clashing_columns_are_ignored(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", 3)], COLUMNS + ", key string, place int")
    assert trie.ordered_turns(rows).count() == 1
