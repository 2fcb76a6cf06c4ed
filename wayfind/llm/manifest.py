"""A Merkle manifest of a dataset: one root for all rows, and for each row a proof that it is under it.

Rows become leaves, the leaves of each tree (one for each value of a column) are hashed in pairs
up to a subroot, and the subroots are the leaves of one more tree, whose root stands for the
dataset. A proof lists the siblings on the way up; who has it, the row and the root needs
nothing else.

**Checkpoint and recompute:** only every ``LEVELS``-th level is written. The nodes between are
those of aligned subtrees of ``2 ** LEVELS`` stored nodes: a task that has the stored nodes of
one subtree makes its missing nodes anew, hands each stored node its siblings, and drops them.
Proofs go down from the root, level by stored level, so the part that a subtree's nodes have in
common is joined once for the subtree. Groups have ``2 ** LEVELS`` nodes at most, whatever the
size of a tree, and places come from ``placed``, so a large tree is spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm.batches import map_texts
from wayfind.llm.places import placed
from wayfind.storage import materialize

LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof is one of these and a digest: the sibling's side, or ALONE without a digest.
LEFT, RIGHT, ALONE = "<", ">", "."


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """The leaf of a row: the digest of its fields, each with its length in bytes, or ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def tree_key(column: str) -> Column:
    """A string for each value, null too, in the order null first and then by bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def rise(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them, lowest first."""
    found = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        found.append(nodes)
    return found


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return (n - 1).bit_length()


def siblings(levels: list[list[str]], place: int) -> list[str]:
    """The steps from a node of the lowest of ``levels`` to the highest."""
    steps = []
    for nodes in levels[:-1]:
        other = place ^ 1
        steps.append(f"{LEFT if other < place else RIGHT}{nodes[other]}" if other < len(nodes) else ALONE)
        place >>= 1
    return steps


def folded(leaf: str, proof: Iterable[str]) -> str:
    """The root that ``leaf`` and ``proof`` lead to."""
    for step in proof:
        side, other = step[:1], step[1:]
        leaf = digest(other, leaf) if side == LEFT else digest(leaf, other)
    return leaf


def _blocks(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(tree, block, n, nodes): stored nodes by aligned subtree, at most ``2 ** LEVELS`` in each."""
    fields = F.struct("place", "hash", *payload)
    return nodes.groupBy("tree", F.shiftright("place", LEVELS).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.array_agg(fields)).alias("nodes"))


def _risen(nodes: DataFrame) -> DataFrame:
    """The next stored level above ``nodes`` (tree, place, hash, n) of trees that have not ended."""

    def up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for n, block in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                levels = min(LEVELS, height(n))
                hashes.append(rise([x["hash"] for x in block], levels)[-1][0])
                sizes.append((n + (1 << levels) - 1) >> levels)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], names=["tree", "place", "hash", "n"])

    return map_texts(_blocks(nodes.where("n > 1"), []), up, "tree string, place long, hash string, n long")


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` (tree, place, hash, n) and every ``LEVELS``-th level above them, as tables."""
    levels = [leaves]
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most > 1:
        levels.append(materialize(_risen(levels[-1]), "level", compact=True))
        most = (most + (1 << LEVELS) - 1) >> LEVELS
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash): what is left of each tree."""
    found = [level.where("n = 1").select("tree", "hash") for level in levels]
    for more in found[1:]:
        found[0] = found[0].unionAll(more)
    return found[0]


def _descended(nodes: DataFrame, above: DataFrame, ends: DataFrame, payload: Sequence[str], emit: Callable | None = None, schema: str = "") -> DataFrame:
    """Proofs of the stored ``nodes``, from those of the stored level ``above`` (tree, place, proof).

    A tree that ends with one node here has the proof of its root in ``ends`` (tree, proof). With
    ``emit`` each block, its proofs and the height of its tree become other rows than (tree, place, proof).
    """

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, block, upper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = rise([x["hash"] for x in block], min(LEVELS, height(n)))
                proofs = [siblings(levels, k) + upper for k in range(len(block))]
                if emit:
                    yield emit(block, proofs, height(n))
                else:
                    places = pa.array([x["place"] for x in block], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(block), pa.string()), places, pa.array(proofs, pa.list_(pa.string()))], names=["tree", "place", "proof"])

    blocks = _blocks(nodes, payload)
    upper = above.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), "proof")
    joined = blocks.where("n > 1").join(upper, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_p")))
    ended = blocks.where("n = 1").join(ends.select(F.col("tree").alias("_t"), "proof"), F.col("tree") == F.col("_t"))
    both = joined.select("tree", "n", "nodes", "proof").unionAll(ended.select("tree", "n", "nodes", "proof"))
    return map_texts(both, down, schema or "tree string, place long, proof array<string>")


def proofs_above(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(tree, place, proof) of the nodes of ``levels[0]``: their siblings up to the root of their tree, and on to ``ends``."""
    none = levels[-1].select("tree", "place", F.array().cast("array<string>").alias("proof")).limit(0)
    for level in reversed(levels):
        none = _descended(level, none, ends, [])
    return none


@dataclass
class Manifest:
    """Stored levels of the trees and of the tree over their subroots."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def build(leaves: DataFrame, payload: Sequence[str] = ()) -> Manifest:
    """The manifest of ``leaves``: tree (string, never null), ``id`` and ``hash``, and the columns of ``payload``.

    Leaves of a tree ascend by (id, hash), a null id first; rows that are equal are leaves of
    their own. Trees ascend by ``tree``. A level's last node is hashed alone if it has no other;
    a tree of one leaf is that leaf. No leaves give the root None.
    """
    table = placed(leaves.select("tree", "id", "hash", *payload), ["tree"], ["id", "hash"], size="n")
    table = materialize(table, "leaves")
    levels = stored_levels(table)
    subroots = materialize(roots(levels), "subroots", compact=True)
    top = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "hash"), ["tree"], ["id"], size="n")
    top = stored_levels(materialize(top, "top", compact=True))
    root = roots(top).first()
    return Manifest(table, levels, subroots, top, root and root["hash"])


def verified(manifest: Manifest, claimed: str = "hash") -> DataFrame:
    """(id, hash, subroot, proof, folded_root): the proof of every leaf, and where the leaf that is ``claimed`` leads with it.

    ``claimed`` names a column of the payload, or the leaves' own hash. ``proof`` is an array of
    steps, lowest first: the side of the sibling and its digest, or a dot where there is none.
    """
    ends = manifest.top[0].sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast("array<string>").alias("proof"))
    top = proofs_above(manifest.top, ends)
    trees = manifest.top[0].select("place", F.col("id").alias("of"))
    subproofs = top.withColumnRenamed("tree", "_tree").join(trees, "place").select(F.col("of").alias("tree"), "proof")
    subproofs = materialize(subproofs, "subproofs", compact=True)
    none = manifest.levels[-1].select("tree", "place", F.array().cast("array<string>").alias("proof")).limit(0)
    for level in reversed(manifest.levels[1:]):
        none = _descended(level, none, subproofs, [])
    payload = list(dict.fromkeys(["id", *([] if claimed == "hash" else [claimed])]))

    def emit(block: list[dict], proofs: list[list[str]], rises: int) -> pa.RecordBatch:
        columns = [
            pa.array([x["id"] for x in block], pa.int64()),
            pa.array([x["hash"] for x in block], pa.string()),
            pa.array([folded(x["hash"], p[:rises]) for x, p in zip(block, proofs, strict=True)], pa.string()),
            pa.array(proofs, pa.list_(pa.string())),
            pa.array([folded(x[claimed], p) for x, p in zip(block, proofs, strict=True)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "hash", "subroot", "proof", "folded_root"])

    return _descended(manifest.levels[0], none, subproofs, payload, emit, "id long, hash string, subroot string, proof array<string>, folded_root string")
