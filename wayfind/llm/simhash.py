"""SimHash near-duplicates, found by the generalised pigeonhole principle.

``fingerprints`` gives each text 64 majority bits over the XXH64 of its shingles.
``link_classes`` joins fingerprints that differ in at most ``distance`` bits: the bits
are grouped into parts by their correlation over all fingerprints, a dynamic programme
gives each part its own threshold by the candidates it is estimated to make, every part
is probed by equality of its key (or of a key with so many flipped bits), and candidates
are verified on all 64 bits. The sum of the thresholds is distance - parts + 1, so any two
fingerprints within the distance agree in some part to within that part's threshold.

Equal fingerprints are one node; links between different ones lead to components. A key
that many fingerprints share is split again on the bits that its part leaves open (see
``_refine``), so that no key's pairs are all compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.batches import by_bytes, map_texts, utf8
from wayfind.llm.components import connected_components
from wayfind.llm.similar import MinHash, shingle_hashes, similar_links
from wayfind.storage import fresh, materialize

BITS = 64


def fingerprint(text: bytes | None, shingle: int, also: MinHash | None = None) -> int:
    """The 64 bits of one text as an unsigned integer; no word gives zero.

    ``also`` is given the same hashes.
    """
    ones, total = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, shingle):
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        total += len(h)
        if also is not None:
            also.add(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(doc_id, fp long) for each row: A-Z lowered, words split at ASCII white space.

    A null or wordless text has fingerprint zero; a text with fewer words than a shingle is
    one shingle. Repeated rows give repeated rows. Other columns are not read. ``keys`` adds
    the keys of the text's MinHash bands and a hash of the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if keys:
        rows = rows.withColumn("digest", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            signs = [MinHash() if keys else None for _ in range(batch.num_rows)]
            values = np.array([fingerprint(t, shingle, also) for t, also in zip(utf8(batch, "text"), signs, strict=True)], np.uint64).view(np.int64)
            made = [batch.column(0), pa.array(values)]
            if keys:
                made += [pa.array([s.band_keys() for s in signs], pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "fp", "keys", "digest"][: len(made)])

    return map_texts(rows, each, f"doc_id {kind}, fp bigint" + ", keys array<bigint>, digest bigint" * keys)


# --- how the bits are grouped and what each group may differ by -------------------------


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits how many have both set."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            seen += len(x)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), seen))], ["cell", "n"])

    cells = dict(map_texts(fps.select("fp"), each, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect())
    grid = np.array([cells.get(k, 0) for k in range(BITS * BITS)], np.float64).reshape(BITS, BITS)
    return int(cells.get(BITS * BITS, 0)), grid


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of near-equal width; a group grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left -= set(group)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one for each part, of least summed cost whose sum is ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (spent, chosen) in best.items():
            for t, price in options.items():
                if done + t not in step or spent + price < step[done + t][0]:
                    step[done + t] = (spent + price, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """The groups of bits and their thresholds, for the number of parts that costs least."""
    n, both = bit_moments(fps)
    p = np.diag(both) / max(n, 1)
    flip = 2 * p * (1 - p)
    ratio = flip / np.maximum(1 - flip, 0.5)
    choices = {m: group_bits(n, both, m) for m in range(2, distance + 3)}
    keys = [(f"{m}:{k}", bits) for m, groups in choices.items() for k, bits in enumerate(groups)]
    probe = fps.select(F.explode(F.array(*(F.struct(F.lit(name).alias("part"), _key(F.col("fp"), bits).alias("key")) for name, bits in keys))).alias("k")).select("k.*")
    counts = probe.groupBy("part", "key").agg(F.count(F.lit(1)).alias("c")).groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    pairs = {r["part"]: r["pairs"] for r in counts.collect()}
    found = []
    for m, groups in choices.items():
        cost = []
        for k, bits in enumerate(groups):
            same, r = pairs.get(f"{m}:{k}", 0.0), ratio[bits]
            options, near, probes = {-1: 0.0}, 1.0, 1.0
            for t in range(distance + 1):
                options[t] = n * probes + same * near
                near += _elementary(r, t + 1)
                probes *= len(bits) + 1
            cost.append(options)
        price, thresholds = allocate(cost, distance - m + 1)
        found.append((price, m, thresholds))
    _, m, thresholds = min(found)
    return [(bits, t) for bits, t in zip(choices[m], thresholds, strict=True) if t >= 0]


def _elementary(r: np.ndarray, k: int) -> float:
    """The sum over all choices of ``k`` bits of the product of their ratios."""
    e = [1.0] + [0.0] * k
    for x in r:
        for j in range(k, 0, -1):
            e[j] += e[j - 1] * x
    return e[k]


# --- probing ------------------------------------------------------------------------------


def _mask(bits: Iterable[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _key(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(_mask(bits)))


def _flips(bits: list[int], most: int) -> list[int]:
    """The masks that flip at most ``most`` of the bits."""
    masks = {0}
    for _ in range(most):
        masks |= {m ^ (1 << b) for m in masks for b in bits}
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in sorted(masks)]


#: A key with more fingerprints than this is split on its open bits before pairs are compared.
REFINE_ABOVE = 64


def _halves(bits: list[int], pieces: int) -> list[list[int]]:
    return [bits[k::pieces] for k in range(pieces)]


def _refine(keyed: DataFrame, bits: list[int], distance: int) -> DataFrame:
    """Key by key again where many fingerprints agree on ``bits``.

    The open bits fall into distance + 1 pieces; two fingerprints within the distance agree
    in one of them, so keys of the part and one more piece lose no pair.
    """
    rest = [b for b in range(BITS) if b not in bits]
    pieces = _halves(rest, distance + 1)
    sub = F.array(*(F.struct(F.lit(k).alias("piece"), _key(F.col("fp"), piece).alias("sub")) for k, piece in enumerate(pieces)))
    return keyed.select("fp", "key", F.explode(sub).alias("s")).select("fp", "key", "s.piece", "s.sub")


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(u, v): pairs of different fingerprints within ``distance`` bits, u > v.

    ``fps`` is a written table of distinct fingerprints. A pair that agrees in several
    parts comes once from each.
    """
    found = []
    for bits, t in plan(fps, distance):
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
        if t > 0:
            probes = fps.select("fp", F.explode(F.array(*(_key(F.col("fp"), bits).bitwiseXOR(F.lit(m)) for m in _flips(bits, t)))).alias("key"))
            held = fps.select(F.col("fp").alias("other"), _key(F.col("fp"), bits).alias("key"))
            found.append(probes.join(held, "key").where((F.col("fp") > F.col("other")) & near).select("fp", "other"))
            continue
        keyed = fps.select("fp", _key(F.col("fp"), bits).alias("key"))
        counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = keyed.join(counted, "key")
        few = shared.where(f"c <= {REFINE_ABOVE}").select("fp", "key")
        many = _refine(shared.where(f"c > {REFINE_ABOVE}"), bits, distance)
        for side, on in ((few, ["key"]), (many, ["key", "piece", "sub"])):
            found.append(side.join(side.withColumnRenamed("fp", "other"), on).where((F.col("fp") > F.col("other")) & near).select("fp", "other"))
    return reduce(DataFrame.unionAll, found).select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()


def link_classes(docs_fp: DataFrame, distance: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, component, component_id) for each distinct fingerprint of the table ``docs_fp``.

    ``component`` is the component's smallest fingerprint, ``component_id`` the smallest doc_id that links reach, null ids aside. ``more`` has further links (u, v).
    """
    fps = materialize(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints", compact=True)
    edges = links(fps.select("fp"), distance)
    comp = materialize(connected_components(edges if more is None else edges.unionAll(more)), "components", compact=True)
    labelled = fps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    smallest = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "c").select("fp", F.col("c").alias("component"), "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``.

    Empty tables give no rows. Repeated rows and equal texts share a fingerprint and so a
    component. Texts without words all have fingerprint zero and are linked like others.
    """
    docs_fp = materialize(fingerprints(docs, shingle, id_col, text_col), "docs_fp")
    classes = link_classes(docs_fp, distance)
    return docs_fp.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A fingerprint as sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _similar_fingerprints(docs_fp: DataFrame, docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(u, v): fingerprints of which any two texts have at least that similarity.

    Every different text is a node of its own, named by its hash; texts of one fingerprint are
    of one component anyway. One row stands for all of equal text and id, whatever its id.
    """
    row = F.xxhash64("digest", "doc_id").alias("id")
    signed = docs_fp.where("size(keys) > 0").select(F.col("digest").alias("node"), F.struct(row, "fp", "keys").alias("s")).groupBy("node").agg(F.min("s").alias("s"))
    signed = materialize(signed.select("node", "s.*"), "signatures", compact=True)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.xxhash64(text), F.col(id_col)).alias("id"), text.alias("text"))
    found = similar_links(signed, rows, "id", "text", shingle, similarity)
    end = lambda name: signed.select(F.col("node").alias(name), F.col("fp").alias(f"{name}_fp"))
    return found.join(end("u"), "u").join(end("v"), "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 2, similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the one with the smallest id.

    Texts are linked by fingerprints within ``distance`` bits, and (unless ``similarity`` is
    None) by a Jaccard similarity of their shingles of at least that. Of several rows of a
    component with the smallest id, or without any id, the first in order of text stays. Rows
    of one id in different components are judged each by its own. All columns are kept as
    they are; an id that occurs once is decided by a join on ids, and only rows of repeated
    ids get their fingerprints again.
    """
    names, own = docs.columns, fresh(docs, "near_dup")
    docs_fp = materialize(fingerprints(docs, shingle, id_col, text_col, keys=similarity is not None), "docs_fp")
    more = None
    if similarity is not None:
        more = _similar_fingerprints(docs_fp, docs, shingle, similarity, id_col, text_col)
    classes = materialize(link_classes(docs_fp, distance, more), "classes", compact=True)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = docs_fp.join(classes, "fp").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("stays")).where("stays")
    ids = materialize(ids.select(F.col("doc_id").alias(f"{own}_id"), F.col("n").alias(f"{own}_n")), "survivors", compact=True)
    # Whether ids fit a broadcast depends on the input, so texts would move at some sizes only.
    rows = docs.join(ids.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(f"{own}_id")))
    once, again = rows.where(f"{own}_n = 1").select(names), rows.where(f"{own}_n > 1").select(names)
    classes = classes.select(*(F.col(c).alias(f"{own}_{c}") for c in classes.columns))
    again = _with_fingerprint(again, text_col, shingle, own).join(classes, F.col(own) == F.col(f"{own}_fp")).where(F.col(id_col).eqNullSafe(F.col(f"{own}_component_id")))
    first = Window.partitionBy(f"{own}_component").orderBy(F.col(text_col))
    return once.unionAll(again.withColumn(f"{own}_place", F.row_number().over(first)).where(f"{own}_place = 1").select(names))


def _with_fingerprint(rows: DataFrame, text_col: str, shingle: int, into: str) -> DataFrame:
    """``rows`` with their fingerprints in a further column."""
    names = [*rows.columns, into]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            values = np.array([fingerprint(t, shingle) for t in utf8(batch, text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names)

    return map_texts(rows, each, T.StructType([*rows.schema.fields, T.StructField(into, T.LongType())]))
