import random

from hypothesis import given
from hypothesis import strategies as st

from tests.compare import SF, connection, rows
from wayfind.llm import chat, queries

PIECES = st.lists(st.sampled_from([*"ab\\#</turn>: \n", "###", "</turn>", "### assistant: "]), max_size=30).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), PIECES), PIECES), max_size=5))
def test_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_query_equals_sql(spark):
    assert rows(queries.op9_chat_format(spark, SF).toPandas()) == rows(connection().sql(queries.OP9_SQL).df())


def brute(messages, branches):
    nodes = {}
    for m in sorted(messages, key=lambda m: (m[1] is not None, m[1] or "", m[3] or 0.0)):
        nodes.setdefault(m[0], m)
    out, parents = [], {m[1] for m in nodes.values()}
    for name in nodes:
        if name in parents:
            continue
        path, at = [], name
        while at in nodes and at not in path:
            path.append(at)
            at = nodes[at][1]
        if at in path:
            continue
        out.append((nodes[name][2], -sum(nodes[p][3] or 0.0 for p in path), -len(path), name, path[::-1]))
    best, counts = [], {}
    for tree, *_, name, path in sorted(out):
        counts[tree] = counts.get(tree, 0) + 1
        if branches is None or counts[tree] <= branches:
            best.append((tree, name, counts[tree], tuple(f"t{p}" for p in path)))
    return sorted(best)


def test_paths_equal_brute_force(spark):
    rng = random.Random(6)
    messages = []
    for tree in range(12):
        for k in range(rng.randint(1, 25)):
            parent = None if k == 0 else f"{tree}.{rng.randint(max(0, k - 3), k - 1)}"
            messages.append((f"{tree}.{k}", parent, tree, float(rng.randint(0, 3)), "user", f"t{tree}.{k}"))
    messages += [("a", "b", 99, 1.0, "user", "ta"), ("b", "a", 99, 1.0, "user", "tb"), ("c", "b", 99, 1.0, "user", "tc"), ("orphan", "gone", 98, None, "user", "torphan")]
    frame = spark.createDataFrame(messages, "node string, parent string, tree long, score double, role string, text string")
    for branches in (1, 2, None):
        got = sorted((r["tree"], r["leaf"], r["rank"], tuple(t["text"] for t in r["turns"])) for r in chat.reply_paths(frame, branches).collect())
        assert got == brute(messages, branches)


def test_long_chain(spark):
    rows_ = [(7, k, "user" if k % 2 else "assistant", str(k)) for k in range(300)]
    got = chat.reply_paths(chat.linear_messages(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 1 and [t["text"] for t in got[0]["turns"]] == [str(k) for k in range(300)]


def test_edge_rows(spark):
    rows_ = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (None, None, "assistant", "a", "y"), (2, 5, "assistant", "### </turn>", "z")]
    frame = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, node string")
    got = {r["id"]: r for r in chat.read_back(chat.format_paths(chat.reply_paths(chat.linear_messages(frame)))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, None: 1, 2: 1} and got[2]["loss_chars"] == 11
    assert chat.read_back(chat.format_paths(chat.reply_paths(chat.linear_messages(frame.where("false"))))).count() == 0
