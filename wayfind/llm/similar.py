"""Links between texts whose word shingles have a Jaccard similarity of 0.8 or more.

Two such texts differ in some ten of 64 SimHash bits, too many for any partition of them to
be selective, so fingerprints within a few bits are joined by links from MinHash bands: 24
bands of 5 values each miss a pair of similarity 0.8 once in 14,000. A band's bucket of few
texts gives all its pairs; in a larger one every text is first paired with the bucket's
smallest and with its most typical text (that with the most texts in all its buckets), so
rows stay in proportion to the texts. Every pair is verified by the exact similarity of its
shingles. Large buckets whose texts are not yet one component are then compared in blocks,
every two texts of different components (see ``_between_components``), so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.batches import by_bytes, map_texts, utf8
from wayfind.llm.components import connected_components
from wayfind.session import share_code
from wayfind.storage import materialize

BANDS, ROWS = 24, 5
#: Buckets of up to so many texts give all their pairs.
ALL_PAIRS = 32
#: Texts, and bytes of shingle hashes, that a block of a large group has on average at most.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 8 << 20
#: Shingles that two blocks are compared on at a time.
COLUMNS = 4096
SEED = 42
BLOCK = 1 << 12
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles in order, block by block: A-Z lowered, words joined by a space.

    A text with fewer words than a shingle is one; one without words has none.
    """
    words = (text or b"").lower().split()
    if len(words) < shingle:
        words, shingle = ([b" ".join(words)], 1) if words else ([], 1)
    hashed = xxhash.xxh64_intdigest
    for first in range(0, len(words) - shingle + 1, BLOCK):
        part = words[first : first + BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        yield np.fromiter((hashed(g, SEED) for g in grams), np.uint64)


class MinHash:
    """The signature of a text, made block by block."""

    def __init__(self) -> None:
        self.least, self.some = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), False

    def add(self, h: np.ndarray) -> None:
        self.some = True
        self.least = np.minimum(self.least, (h[:, None] * _FACTORS + _OFFSETS).min(0))

    def band_keys(self) -> list[int]:
        """One key for each band; none for a text without words."""
        if not self.some:
            return []
        keys = np.zeros(BANDS, np.uint64)
        for row in self.least.reshape(BANDS, ROWS).T:
            keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
        return keys.view(np.int64).tolist()


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams) from (node, text): the sorted distinct hashes as bytes."""

    def one(text: bytes | None) -> bytes:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)])).tobytes()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            grams = pa.array([one(t) for t in utf8(batch, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["node", "grams"])

    return map_texts(texts, each, "node bigint, grams binary")


def _buckets(signed: DataFrame) -> DataFrame:
    """(band, key, node, c, least): the texts of each bucket of several, with its size and smallest node."""
    rows = signed.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = materialize(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("least")).where("c > 1"), "buckets", compact=True)
    return materialize(rows.join(sizes, ["band", "key"]), "bucketed")


def candidate_pairs(signed: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(u, v) distinct, u > v, from the written table (node, keys): all pairs of small buckets, stars of large ones."""
    held = _buckets(signed) if held is None else held
    few = held.where(f"c <= {ALL_PAIRS}").select("band", "key", "node")
    pairs = few.join(few.withColumnRenamed("node", "other"), ["band", "key"]).where("node > other").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    many = held.where(f"c > {ALL_PAIRS}")
    fame = many.groupBy("node").agg(F.sum("c").alias("fame"))
    typical = many.join(fame, "node").groupBy("band", "key").agg(F.max_by("node", F.struct("fame", "node")).alias("typical"))
    stars = many.join(typical, ["band", "key"]).select("node", F.explode(F.array("least", "typical")).alias("other")).where("node <> other")
    stars = stars.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
    return pairs.unionAll(stars).distinct()


def _similar(a: bytes, b: bytes, least: float) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _block_links(rows: pa.Table, least: float) -> pa.Table:
    """(u, v): similar texts of two blocks, as many as join their components; rows are (a, b, block, node, component, grams)."""
    block, node, component = (rows.column(c).to_numpy() for c in ("block", "node", "component"))
    sets = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
    sides = [np.flatnonzero(block == rows.column(c)[0].as_py()) for c in ("a", "b")]
    held = [np.concatenate([sets[k] for k in side]) for side in sides]
    shared = np.intersect1d(np.unique(held[0]), np.unique(held[1]), assume_unique=True)
    cells = []
    for side, values in zip(sides, held, strict=True):
        row = np.repeat(np.arange(len(side)), [len(sets[k]) for k in side])
        known = np.isin(values, shared)
        row, column = row[known], np.searchsorted(shared, values[known])
        order = np.argsort(column, kind="stable")
        cells.append((row[order], column[order], len(side)))
    both = np.zeros((len(sides[0]), len(sides[1])))
    for first in range(0, len(shared), COLUMNS):
        dense = []
        for row, column, n in cells:
            lo, hi = np.searchsorted(column, [first, first + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(shared) - first)), np.float32)
            part[row[lo:hi], column[lo:hi] - first] = 1
            dense.append(part)
        both += dense[0] @ dense[1].T
    x, y = (np.array([len(sets[k]) for k in side], np.float64) for side in sides)
    near = (both >= least * (x[:, None] + y - both) - 1e-9) & (component[sides[0]][:, None] != component[sides[1]])
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    found = []
    for i, j in zip(*(side[k].tolist() for side, k in zip(sides, np.nonzero(near), strict=True)), strict=True):
        p, q = top(int(component[i])), top(int(component[j]))
        if p != q:
            above[p] = q
            found.append((max(node[i], node[j]), min(node[i], node[j])))
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _between_components(held: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(u, v): links that join components of the table ``known`` (node, component) over large buckets, or None if none is open.

    A large bucket is open while its texts are of several components. Open buckets that share
    a text are one cluster. Its components of a block and more fall into blocks of their own,
    all smaller ones together into mixed blocks, and every two blocks that are not of one
    component meet in one task, which compares all their texts by a product of matrices.
    """
    many = held.where(f"c > {ALL_PAIRS}").join(known, "node")
    unsettled = many.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "key")
    members = materialize(many.join(unsettled, ["band", "key"]).select("node", "least", "component"), "unsettled", compact=True)
    if members.isEmpty():
        return None
    clusters = connected_components(members.select(F.col("node").alias("u"), F.col("least").alias("v"))).withColumnRenamed("component", "cluster")
    sized = sets.select("node", F.length("grams").cast("long").alias("bytes"))
    placed = members.select("node", "component").distinct().join(clusters, "node").join(sized, "node")
    # Mixed blocks are marked by no component of their own.
    whole = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {BLOCK_TEXTS}").select("cluster", "component", F.col("component").alias("own"))
    placed = placed.join(whole, ["cluster", "component"], "left")
    width = F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES)
    parts = placed.groupBy("cluster", "own").agg(F.ceil(width).alias("parts")).withColumnRenamed("cluster", "_c").withColumnRenamed("own", "_o")
    placed = placed.join(parts, (F.col("cluster") == F.col("_c")) & F.col("own").eqNullSafe(F.col("_o")))
    part = F.pmod(F.xxhash64("node"), "parts")
    placed = placed.select("node", "component", "cluster", "own", F.xxhash64("cluster", F.coalesce(F.col("own").cast("string"), F.lit("mixed")), part).alias("block"))
    placed = materialize(placed, "blocks", compact=True)
    blocks = placed.select("cluster", "own", "block").distinct()
    other = blocks.select("cluster", F.col("own").alias("_own"), F.col("block").alias("b"))
    met = blocks.withColumnRenamed("block", "a").join(other, "cluster").where("a <= b and (own is null or _own is null or own <> _own)")
    sides = met.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    rows = sides.join(placed.select("node", "component", "block").join(sets, "node").hint("shuffle_hash"), "block")
    share_code(held.sparkSession)

    def each(rows: pa.Table) -> pa.Table:
        return _block_links(rows, similarity)

    return rows.select("a", "b", "block", "node", "component", "grams").groupBy("a", "b").applyInArrow(each, "u bigint, v bigint")


def _known_components(signed: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of every node by the links ``found`` and by equal fp, where ``signed`` has it."""
    of = signed.select("node", (F.col("fp") if "fp" in signed.columns else F.col("node")).alias("fp"))
    end = lambda name: of.select(F.col("node").alias(name), F.col("fp").alias(f"{name}_fp"))
    links = found.join(end("u"), "u").join(end("v"), "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))
    joined = connected_components(links).withColumnRenamed("node", "fp")
    return of.join(joined, "fp", "left").select("node", F.coalesce("component", "fp").alias("component"))


def similar_links(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(u, v): nodes of at least that similarity: all in small buckets, in large ones enough to give the same components.

    ``signed`` is a written table of one row a node: node bigint, id (of a document with its
    text) and keys; with a column fp, nodes of one fp are of one component whatever their links.
    Texts without words have no link here. Texts move once, to meet the ids of those in any pair.
    """
    held = _buckets(signed)
    pairs = materialize(candidate_pairs(signed, held), "pairs", compact=True)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(signed.select("node", F.col("id").alias("_wanted")), "node")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # By hash at every size, so that what moves grows evenly with the input.
    met = texts.join(wanted.hint("shuffle_hash"), F.col("_id") == F.col("_wanted")).select("node", "text")
    sets = materialize(_sets(met, shingle).groupBy("node").agg(F.min("grams").alias("grams")), "shingles")
    side = lambda end: sets.select(F.col("node").alias(end), F.col("grams").alias(f"{end}_grams"))
    both = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(a, b, similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(map_texts(both.select("u", "v", "u_grams", "v_grams"), each, "u bigint, v bigint"), "similar", compact=True)
    if held.where(f"c > {ALL_PAIRS}").isEmpty():
        return found
    known = _known_components(signed, found)
    more = _between_components(held, materialize(known, "known", compact=True), sets, similarity)
    return found if more is None else found.unionAll(more)
