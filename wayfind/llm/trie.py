"""A trie of conversation prefixes: what a prefix cache saves if equal beginnings are read once.

Every distinct beginning of a conversation is a node, named by the smallest conversation that
begins so and its depth. Totals over subtrees come by the **Euler-tour technique**: each node
has an arc in and an arc out; the arcs in the order of a depth-first walk form one list; the
list is ranked distributedly; and a subtree's total is the difference of the running totals at
its two arcs.

* A node has its smallest conversation in common with one child at most, so arcs lie on paths,
  one for each conversation, along which the walk mostly runs on. Stretches of a path that the
  walk runs through at once become one link each (windows of ``BLOCK`` depths bound them), so
  the list to be ranked is as long as there are branches, not turns.
* The links are ranked by pointer jumping: each round adds the totals of the link pointed to
  and doubles the reach, by one equi-join; the rounds are the logarithm of the links. A round
  ends in a table in the shared folder, and that of the round before is removed.
* Keys of prefixes are digests over blocks of ``PREFIX`` turns, then over digests of blocks and
  so on, so that no task needs a whole conversation.
* Siblings get their places by ``placed``: a node with a third of all nodes as its children is
  spread over many tasks. So are the ids of the conversations that end at one node; they are
  joined to long pieces before one task digests them as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.batches import map_texts
from wayfind.llm.places import placed
from wayfind.storage import materialize, release

PREFIX = 64
BLOCK = 4096
PIECE_IDS = 4096
ENTER, LEAVE = 0, 1


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, size, said, tokens): turns by (turn, role, text), null turns first.

    ``said`` digests role and text, ``tokens`` is the text's length in code points. A null role or
    text is empty; rows without a conv_id are no turns; repeated rows are turns of their own.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return placed(rows, ["conv_id"], ["turn", "role", "text"], size="size").select("conv_id", "place", "size", said.alias("said"), F.length("text").cast("long").alias("tokens"))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, place, said, ...) with ``key``: equal where all turns so far are equal."""
    most = turns.agg(F.max("place")).first()[0]
    block = F.floor(F.col("place") / PREFIX)
    so_far = Window.partitionBy("conv_id", block).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumn("key", _digest(F.array_join(F.transform(F.collect_list("said").over(so_far), F.hex), "")))
    if most is None or most < PREFIX:
        return turns
    turns = materialize(turns, "keys")
    ends = turns.where(F.col("place") % PREFIX == PREFIX - 1).select("conv_id", block.alias("place"), F.col("key").alias("said"))
    before = prefix_keys(ends).select(F.col("conv_id").alias("_c"), (F.col("place") + 1).alias("_b"), F.col("key").alias("_k"))
    later = turns.where(f"place >= {PREFIX}").join(before, (F.col("conv_id") == F.col("_c")) & (block == F.col("_b")))
    return turns.where(f"place < {PREFIX}").unionByName(later.withColumn("key", _digest("_k", "key")).select(turns.columns))


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): for each key the digest of its conv_ids, ascending, joined by commas."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: bytes, ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

        of, held = None, []
        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (key != of or len(held) >= PIECE_IDS):
                    yield made(of, held)
                    held = []
                of = key
                held.append(conv)
        if held:
            yield made(of, held)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

        of, state = None, None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state and key == of:
                    state.update(b",")
                elif state:
                    yield made(of)
                if not state or key != of:
                    of, state = key, hashlib.sha256()
                state.update(ids.encode())
        if state:
            yield made(of)

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = map_texts(dealt, pieces, "key binary, first long, ids string")
    return map_texts(joined.repartition(n, "key").sortWithinPartitions("key", "first"), digests, "key binary, ends_sha256 string")


def _nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, conv_id, depth, parent_key, n_convs, tokens) of every prefix, the empty one too."""
    keyed = materialize(prefix_keys(turns).select("conv_id", (F.col("place") + 1).alias("depth"), "key", "tokens"), "members")
    above = keyed.select(F.col("conv_id").alias("_c"), (F.col("depth") + 1).alias("_d"), F.col("key").alias("_k"))
    least = keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("tokens").alias("tokens"))
    below = least.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    empty = F.lit(b"")
    below = below.select("key", "conv_id", "depth", F.coalesce("_k", empty).alias("parent_key"), "n_convs", "tokens")
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(empty.alias("key"), "conv_id", zero.alias("depth"), F.lit(None).cast("binary").alias("parent_key"), "n_convs", zero.alias("tokens"))
    ended = keyed.join(lengths.select(F.col("conv_id").alias("_c"), "length"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("length"))).select("key", "conv_id")
    ended = ends_digest(ended.unionAll(lengths.where("length = 0").select(empty.alias("key"), "conv_id")))
    found = root.unionAll(below).join(ended.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"), "left").drop("_k")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def _linked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their parent, first child, next sibling and number of children, each by its conversation.

    A child is one deeper, so with its conversation it is known.
    """
    names = nodes.select(F.col("key").alias("_k"), F.col("conv_id").alias("parent_conv_id"))
    nodes = materialize(nodes.join(names, F.col("parent_key") == F.col("_k"), "left").drop("_k", "key", "parent_key"), "nodes")
    order = placed(nodes.where("depth > 0").select("parent_conv_id", "depth", "conv_id"), ["parent_conv_id", "depth"], ["conv_id"], size="n")
    order = materialize(order, "siblings")
    firsts = order.where("place = 0").select(F.col("parent_conv_id").alias("_p"), (F.col("depth") - 1).alias("_d"), F.col("conv_id").alias("child"), F.col("n").alias("n_children"))
    after = order.select(F.col("parent_conv_id").alias("_q"), F.col("depth").alias("_e"), (F.col("place") - 1).alias("_i"), F.col("conv_id").alias("sibling"))
    order = order.join(after, (F.col("parent_conv_id") == F.col("_q")) & (F.col("depth") == F.col("_e")) & (F.col("place") == F.col("_i")))
    following = order.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_f"), "sibling")
    out = nodes.join(firsts, (F.col("conv_id") == F.col("_p")) & (F.col("depth") == F.col("_d")), "left")
    out = out.join(following, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_f")), "left")
    return out.drop("_p", "_d", "_c", "_f").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def _arc(kind: int | Column, conv: Column, depth: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), conv.alias("conv_id"), depth.cast("long").alias("depth"))


def tour(nodes: DataFrame) -> DataFrame:
    """(kind, conv_id, depth, follows, leaves, saved): the arcs, each with the one that follows it."""
    conv, depth = F.col("conv_id"), F.col("depth")
    entered = F.when(F.col("child").isNotNull(), _arc(ENTER, F.col("child"), depth + 1)).otherwise(_arc(LEAVE, conv, depth))
    left = F.when(F.col("sibling").isNotNull(), _arc(ENTER, F.col("sibling"), depth)).when(depth > 0, _arc(LEAVE, F.col("parent_conv_id"), depth - 1))
    leaves, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("tokens")
    zero = F.lit(0).cast("long")
    arcs = F.array(
        F.struct(F.lit(ENTER).alias("kind"), entered.alias("follows"), leaves.alias("leaves"), saved.alias("saved")),
        F.struct(F.lit(LEAVE).alias("kind"), left.alias("follows"), zero.alias("leaves"), zero.alias("saved")),
    )
    return nodes.select("conv_id", "depth", F.explode(arcs).alias("a")).select("a.kind", "conv_id", "depth", "a.follows", "a.leaves", "a.saved")


def ranked_totals(arcs: DataFrame) -> DataFrame:
    """(kind, conv_id, depth, rest, leaves, saved): for each arc the arcs, leaves and savings from it to the end."""
    on_path = Window.partitionBy("conv_id", F.floor(F.col("depth") / BLOCK)).orderBy("kind", F.when(F.col("kind") == ENTER, F.col("depth")).otherwise(-F.col("depth")))
    here = _arc(F.col("kind"), F.col("conv_id"), F.col("depth"))
    arcs = arcs.withColumn("follows", F.when(F.col("follows").isNotNull(), F.col("follows"))).withColumn("ends", (~F.lead(here).over(on_path).eqNullSafe(F.col("follows"))).cast("long"))
    arcs = arcs.withColumn("link", F.coalesce(F.sum("ends").over(on_path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    arcs = arcs.withColumn("block", F.floor(F.col("depth") / BLOCK)).withColumn("step", F.row_number().over(on_path))
    arcs = materialize(arcs, "arcs")
    of_link = ["conv_id", "block", "link"]
    head, last = F.min_by(_arc(F.col("kind"), F.col("conv_id"), F.col("depth")), "step"), F.max_by("follows", "step")
    links = arcs.groupBy(*of_link).agg(head.alias("head"), last.alias("to"), F.count(F.lit(1)).alias("rest"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = ["rest", "leaves", "saved"]
    state = materialize(links, "links")
    while state.where("to is not null").limit(1).count():
        target = state.select(F.col("head").alias("_h"), F.col("to").alias("_to"), *(F.col(s).alias(f"_{s}") for s in sums))
        moved = state.where("to is not null").join(target, F.col("to") == F.col("_h")).select(*of_link, "head", F.col("_to").alias("to"), *((F.col(s) + F.col(f"_{s}")).alias(s) for s in sums))
        last_state, state = state, materialize(state.where("to is null").unionByName(moved), "links", compact=True)
        release(last_state)
    total = state.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("link").alias("_l"), *(F.col(s).alias(f"_{s}") for s in sums))
    within = Window.partitionBy(*of_link).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = {"rest": F.count(F.lit(1)).over(within), "leaves": F.coalesce(F.sum("leaves").over(within), F.lit(0)), "saved": F.coalesce(F.sum("saved").over(within), F.lit(0))}
    out = arcs.select("kind", "depth", *of_link, *(c.alias(s) for s, c in before.items()))
    out = out.join(total, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")) & (F.col("link") == F.col("_l")))
    return out.select("kind", "conv_id", "depth", *((F.col(f"_{s}") - F.col(s)).alias(s) for s in sums))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enters) of each node.

    ``turns`` has conv_id, place (from 0 on, without gaps), said and tokens, as ``ordered_turns``
    makes them; ``lengths`` has each conv_id once, with its number of turns, 0 too. Nothing may be
    null. ``conv_id`` is a node's smallest member; the root has depth 0 and no parent.
    ``saved_tokens`` sums, over the subtree, a node's tokens for each member but one. ``enters`` is
    the place of the arc into the node in the tour, from 0 on: depth-first order, siblings by
    conv_id. Equal conversations are members of the same nodes. No conversations give no rows.
    """
    nodes = materialize(_linked(_nodes(turns, lengths)), "trie")
    totals = ranked_totals(tour(nodes))
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    inside = totals.groupBy("conv_id", "depth").agg(
        (at(ENTER, "leaves") - at(LEAVE, "leaves")).alias("n_leaves"), (at(ENTER, "saved") - at(LEAVE, "saved")).alias("saved_tokens"), at(ENTER, "rest").alias("rest")
    )
    arcs = 2 * nodes.count()
    inside = inside.withColumn("enters", arcs - F.col("rest")).withColumnsRenamed({"conv_id": "_c", "depth": "_d"})
    out = nodes.join(inside, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enters")
