from pyspark.sql import functions as F

from wayfind.llm import mixing


def waterfill(sizes, weights, most=3):
    """Share by weight, cap, share what is over again, until nothing is."""
    total, capped = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left, w = total - sum(most * sizes[k] for k in capped), sum(weights[k] for k in free)
        target = [most * sizes[k] if k in capped else left * weights[k] / w for k in range(len(sizes))]
        over = {k for k in free if target[k] > most * sizes[k]}
        if not over:
            return target
        capped |= over


def test_targets_equal_repeated_sharing(spark):
    for sizes in ([100, 100, 100], [1, 1000, 1000, 5, 0], [10, 0, 0, 0], [3, 1, 500, 2, 7, 900], [7]):
        table = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(table).collect()}
        for k, t in enumerate(waterfill(sizes, [1 + k % 3 for k in range(len(sizes))])):
            assert abs(got[f"s{k}"] - t) < 1e-6, (sizes, got)


def test_mix_is_near_targets_and_repeats(spark):
    rows = [(k, " ".join(["w"] * (k % 40)), None if k % 9 == 0 else f"s{k % 4}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=lambda r: r[0]) for n in (2, 7))
    assert first == again and len(first) == 3000
    by = {}
    for doc_id, size, source, source_size, target, copies, taken, _ in first:
        assert taken == copies * size <= 3 * size and size == doc_id % 40
        by.setdefault((source, target), [0, 0])[0] += taken
    assert sum(v[0] for v in by.values()) <= sum(r[1] for r in first)
    for (_, target), (taken, _) in by.items():
        assert abs(taken - target) <= 80
    finish = [r["first_finish"] for r in mixing.mix(docs).collect()]
    taken = [f for f in finish if f is not None]
    assert taken == sorted(taken) and finish[: len(taken)] == taken  # in the order of the queue, then what it leaves out


def test_hot_source_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = [(k, "a b c", "hot" if k % 3 else f"s{k % 5}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10_000)
    assert few == sorted(map(tuple, mixing.mix(docs).collect()))


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", None, 2), (3, "x y", "b", 3), (3, "x y", "b", 3), (None, "z", None, 4)], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 5
    assert {r["source_size"] for r in got if r["source"] == "a"} == {0}
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("text is null")).first()["taken"] == 0


def test_word_count(spark):
    row = spark.sql("select 'a b\tc\\n d' as t, cast(null as string) as n").select(mixing.word_count(F.col("t")), mixing.word_count(F.col("n"))).first()
    assert tuple(row) == (3, 0)
