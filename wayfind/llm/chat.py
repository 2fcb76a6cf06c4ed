"""Reply trees to conversations.

Messages name their parents. Root-to-leaf paths are found by iterated self-joins in which
each round doubles the reach of every message's pointer to an ancestor (a chain of 1,000
turns takes ten rounds), summing scores on the way. Leaves are ranked by the score of
their path, and only for the chosen ones are the ancestors listed, again by one join for
each doubling. A path then becomes one formatted text.

The template writes a turn as ``### role: text </turn>`` and a line end. Inside roles and
texts a backslash comes before each backslash, ``###`` and ``</turn>`` (and before a colon
in a role), so what a message says can never open or close a turn, and unescaping gives
back exactly what it said.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.batches import map_texts
from wayfind.storage import materialize, release

TRAINED_ROLE = "assistant"

# The template's control strings.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE_END = re.compile(r"\\.|:", re.DOTALL)
_TEXT_END = re.compile(r"\\.|</turn>", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Iterable[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of its trained texts in code points; nulls are empty."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role or '', role=True)}{MIDDLE}", escape(text or "")
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, at = [], 0

    def end_of(pattern: re.Pattern, closing: str, start: int) -> int:
        for m in pattern.finditer(formatted, start):
            if m[0] == closing:
                return m.start()
        raise ValueError(f"turn at {at} does not end")

    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role_end = end_of(_ROLE_END, ":", at + len(OPEN))
        text_at = role_end + len(MIDDLE)
        close = end_of(_TEXT_END, "</turn>", text_at)
        turns.append((unescape(formatted[at + len(OPEN) : role_end]), unescape(formatted[text_at : close - 1])))
        at = close - 1 + len(CLOSE)
    return turns


def reply_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, turns): the best root-to-leaf paths of each tree.

    ``messages`` has node, parent, tree, score, role and text; more columns are ignored. Of
    rows with one node the smallest (parent, score, role, text) counts. A null node is no
    message; a parent that is null or unknown makes a root; messages whose parents form a
    ring, and their replies, reach no root and are on no path. A null score is 0. A path's
    score is the sum of its messages'; of equal scores the longer path, then the smaller
    leaf, comes first. ``branches`` is how many paths a tree gives, None for all. ``turns`` is
    an array of structs (role, text) from the root on. An empty table gives no rows.
    """
    fields = F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "tree", "role", "text")
    nodes = materialize(messages.where("node is not null").groupBy("node").agg(F.min(fields).alias("m")).select("node", "m.*"), "messages")
    known = nodes.select(F.col("node").alias("_k"))
    state = materialize(
        nodes.join(known, F.col("parent") == F.col("_k"), "left").select("node", F.col("_k").alias("jump"), "score", F.lit(1).cast("long").alias("depth")), "jumps"
    )
    hops, left = [], nodes.count()
    while left and state.where("jump is not null").limit(1).count():  # only messages not yet at their root move on
        moving, left = state.where("jump is not null"), left // 2
        hops.append(moving.select(F.col("node").alias("_n"), "jump"))
        there = state.select(F.col("node").alias("_n"), F.col("jump").alias("_j"), F.col("score").alias("_s"), F.col("depth").alias("_d"))
        step = moving.join(there, F.col("jump") == F.col("_n")).select("node", F.col("_j").alias("jump"), (F.col("score") + F.col("_s")).alias("score"), (F.col("depth") + F.col("_d")).alias("depth"))
        state = materialize(state.where("jump is null").unionAll(step), "jumps", compact=True)
    done = state.where("jump is null")
    parents = nodes.select(F.col("parent").alias("_p")).distinct()
    leaves = done.join(parents, F.col("node") == F.col("_p"), "left_anti").join(nodes.select(F.col("node").alias("_n"), "tree"), F.col("node") == F.col("_n"))
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "node")
    chosen = leaves.select("tree", F.col("node").alias("leaf"), "score", F.row_number().over(order).alias("rank"))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    chosen = materialize(chosen, "leaves")
    members = chosen.select("leaf", F.col("leaf").alias("at"), F.lit(0).cast("long").alias("up"))
    for k, hop in enumerate(hops):
        above = members.join(hop, F.col("at") == F.col("_n")).select("leaf", F.col("jump").alias("at"), (F.col("up") + 2**k).alias("up"))
        fewer, members = members, materialize(members.unionAll(above), "members", compact=True)
        release(fewer)
    said = nodes.select(F.col("node").alias("_n"), "role", "text")
    turn = F.struct((-F.col("up")).alias("up"), "role", "text")
    paths = members.join(said, F.col("at") == F.col("_n")).groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    paths = paths.select(F.col("leaf").alias("_l"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return chosen.join(paths, F.col("leaf") == F.col("_l")).select("tree", "leaf", "rank", "score", "turns")


def linear_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations without branches: each turn answers the one before.

    Turns are in order of number (null first), then role and text, so repeated rows are turns
    of their own. All conversations without an id are one.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    own = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    placed = own.withColumn("place", F.row_number().over(order))
    name = lambda place: F.concat(F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null")), F.lit("#"), place.cast("string"))
    return placed.select(name(F.col("place")).alias("node"), F.when(F.col("place") > 1, name(F.col("place") - 1)).alias("parent"), "tree", F.lit(0.0).alias("score"), "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """``paths`` with formatted (string) and loss_spans (code points) in place of turns."""
    kept = [c for c in paths.columns if c != "turns"]
    rows = paths.select(*kept, "turns")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render((t["role"], t["text"]) for t in turns) for turns in batch.column(len(kept)).to_pylist()]
            texts = pa.array([t for t, _ in made], pa.string())
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], span)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts, spans], [*kept, "formatted", "loss_spans"])

    return map_texts(rows, each, schema)


def read_back(formatted: DataFrame, id_col: str = "tree") -> DataFrame:
    """Counts and digests of each formatted text, from that text and its spans alone."""
    rows = formatted.select(F.col(id_col).alias("id"), "formatted", "loss_spans")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def one(text: str, spans: list) -> tuple:
        turns = parse(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        return len(turns), digest("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), digest(loss), len(text)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [one(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names)

    return map_texts(rows, each, schema)
