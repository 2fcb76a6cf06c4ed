import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wayfind.llm import manifest, places


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """All levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def steps(levels, place):
    out = []
    for nodes in levels[:-1]:
        run = place // 2 * 2
        out.append([(k < place, nodes[k]) for k in range(run, min(run + 2, len(nodes))) if k != place])
        place //= 2
    return out


def fold(leaf, path):
    for others in path:
        leaf = h(*(x for left, x in others if left), leaf, *(x for left, x in others if not left))
    return leaf


def slowly(rows):
    """(id, hash, subroot, siblings, folded root) of (tree, id, hash, claimed) rows, and the root."""
    trees = {t: sorted((r for r in rows if r[0] == t), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for t in {r[0] for r in rows}}
    made = {t: climb([r[2] for r in trees[t]]) for t in trees}
    names = sorted(trees)
    top = climb([made[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for place, (_, id, hash, claimed) in enumerate(trees[t]):
            path = steps(made[t], place) + steps(top, k)
            out.append((id, hash, made[t][-1][0], "".join(x for others in path for _, x in others), fold(claimed, path)))
    return sorted(out, key=repr), top[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 8])
@pytest.mark.parametrize("sizes", [[1], [2], [5, 1, 0, 17, 64], [65, 33, 3]])
def test_equals_slow_trees(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rnd = random.Random(4)
    rows = [(f"={t}", rnd.choice([None, *range(1000)]), h(f"{t}/{k}"), h(f"{t}/{k}" if k % 3 else "forged")) for t, n in enumerate(sizes) for k in range(n)]
    made = manifest.build(spark.createDataFrame(rows, "tree string, id long, hash string, claimed string").repartition(3), ["claimed"])
    want, root = slowly(rows)
    got = manifest.verified(made, "claimed").collect()
    assert made.root == root
    assert sorted(((r.id, r.hash, r.subroot, "".join(s[1:] for s in r.proof), r.folded_root) for r in got), key=repr) == want
    assert all((r.folded_root == root) == (manifest.folded(r.hash, r.proof) == root and r.hash != h("forged") and (r.id, r.hash, r.hash) in {x[1:] for x in rows}) for r in got)


def test_only_every_few_levels_are_stored(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 3)
    rows = [("=a", k, h(str(k))) for k in range(100)]
    made = manifest.build(spark.createDataFrame(rows, "tree string, id long, hash string"))
    assert [level.count() for level in made.levels] == [100, 13, 2, 1]


def test_leaf_takes_nulls_lengths_and_bytes(spark):
    row = spark.createDataFrame([(7, None, "dé", 12, "")], "doc_id long, source string, lang string, n_chars long, text string")
    assert row.select(manifest.leaf_of([F.col(f) for f in manifest.FIELDS])).first()[0] == h("1:7", "-", "3:dé", "2:12", "0:")


def test_empty_table_has_no_root(spark):
    made = manifest.build(spark.createDataFrame([], "tree string, id long, hash string"))
    assert made.root is None
    assert manifest.verified(made).collect() == []


def test_repeated_rows_are_leaves_of_their_own(spark):
    rows = [("", 1, h("a"), h("a"))] * 3
    made = manifest.build(spark.createDataFrame([r[:3] for r in rows], "tree string, id long, hash string"))
    assert made.root == slowly(rows)[1]
    assert [r.folded_root for r in manifest.verified(made).collect()] == [made.root] * 3


def test_places_of_a_hot_group_cross_partitions(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, "a", "a", "a", "b"]), rnd.choice([None, *range(50)]), k) for k in range(500)]
    got = places.placed(spark.createDataFrame(rows, "g string, v long, k long"), ["g"], ["v", "k"], size="n", parts=7).collect()
    for g in (None, "a", "b"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        order = [(r.v is not None, r.v or 0, r.k) for r in mine]
        assert order == sorted(order)
