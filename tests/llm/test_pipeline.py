import re

import corpus_pipeline
from tests.compare import SF
from tests.llm.test_quality import brute as counts
from tests.llm.test_secrets import base_spans
from tests.llm.test_similar import jaccard
from wayfind.llm import decontaminate


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        results[name] = [r.asDict() for r in out.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            kept = spark.createDataFrame([tuple(r[c] for c in columns) for r in results[name]], docs.schema)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"]: r["text"] for r in results["quality rules"]}
    assert set(good) <= {d for d, t in before.items() if not counts(t)[5]} and all(before[d] == t for d, t in good.items())
    one = {r["doc_id"]: r["text"] for r in results["near-duplicates"]}
    gone = set(good) - set(one)
    assert all(any(jaccard(good[d], t) >= 0.5 for t in one.values()) for d in gone)
    ids = sorted(one)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if jaccard(one[a], one[b]) >= 0.8]
    clean = {r["doc_id"] for r in results["decontamination"]}
    items = [b" ".join(decontaminate.tokens(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {d for d, t in one.items() if any(b" " + i + b" " in b" " + b" ".join(decontaminate.tokens(t)) + b" " for i in items)}
    assert whole and not whole & clean and len(one) - len(clean) < 0.2 * len(one)
    final = {r["doc_id"]: r["text"] for r in results["secret scans"]}
    assert set(final) == clean
    for d, t in final.items():
        assert (t == one[d]) if not base_spans(one[d]) else not base_spans(t.replace("[SECRET]", " "))
    mixed = results["source mix"]
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in final.items()}
    assert {r["doc_id"] for r in mixed} <= clean and all(r["copies"] > 0 and r["taken"] == r["copies"] * size[r["doc_id"]] for r in mixed)
    assert 0.9 * sum(size.values()) < sum(r["taken"] for r in mixed) <= sum(size.values())


def test_run_is_all_stages_and_agrees_with_itself(spark):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == again and first


def test_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in dict(corpus_pipeline.STAGES).values():
        assert stage(spark, docs.where("false"), SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "x " * 30_000, None, "s", 5)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 4, name
