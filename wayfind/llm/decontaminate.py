"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens at the 1s of a fixed mask; the 0s are ignored, so a
substitution there does no harm. The masks below meet every run of 13 tokens with at most
2 substitutions, and of 15 with at most 3, twice or more; ``SHORT_MASK`` is added for items
under ``MIN_OVERLAP`` tokens, and an item under ``MIN_ITEM`` tokens is one seed, to be found
word for word. One pass over the documents makes the seeds of every position and keeps
documents whose seeds a Bloom filter of the benchmark's seeds (of bounded size) knows
often enough. Their seeds are then joined with the benchmark's seeds by a shuffle, and each
pair of document and item is verified around its hits: along each hit's diagonal the longest
stretch with four matches to a substitution is sought, and it must span ``MIN_OVERLAP``
tokens or the whole item. Documents that the filter keeps are shuffled; others never are,
and the benchmark may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfind.llm.batches import by_bytes, map_texts, utf8
from wayfind.storage import fresh, materialize

MASKS = ("111011", "110111", "11111")
SHORT_MASK = "1111"
MIN_OVERLAP = 13
MIN_ITEM = 8
PENALTY = 4
#: Bits of the Bloom filter for each seed, their number at most (32 MB), and bits that a seed sets.
FILTER_BITS, MOST_FILTER_BITS, PROBES = 32, 1 << 28, 4
#: Diagonals of a document and an item that are compared at a time.
DIAGONALS = 1024

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPLIT = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def tokens(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    text = text or b""
    if isinstance(text, bytes):
        if text.isascii():
            return text.lower().translate(_SPLIT).split()
        text = text.decode("utf-8", "replace")
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def kinds_of(n_tokens: int) -> list[str]:
    """The seeds of an item of so many tokens: a class of items (l, s or x) and a mask."""
    if n_tokens < MIN_ITEM:
        return ["x" + "1" * n_tokens] if n_tokens else []
    return [f"l{m}" for m in MASKS] if n_tokens >= MIN_OVERLAP else [f"s{m}" for m in (*MASKS, SHORT_MASK)]


def _seeds(h: np.ndarray, kind: str) -> np.ndarray:
    """The seed at each position from which the kind's mask fits; kinds share no seeds but by chance."""
    n = len(h) - len(kind) + 2
    made = np.full(max(n, 0), xxhash.xxh64_intdigest(kind), np.uint64)
    for k, bit in enumerate(kind[1:]):
        if bit == "1" and n > 0:
            made = (made ^ h[k : k + n]) * _ODD[0]
            made ^= made >> np.uint64(29)
    return made


def longest_similar(same: np.ndarray) -> tuple[int, int]:
    """The first of the longest stretches with ``PENALTY`` matches for each substitution at least.

    With a match worth 1 and a substitution -PENALTY it is the longest stretch of no loss:
    from each start on, the last end whose running sum is not below the start's.
    """
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    ahead = np.maximum.accumulate(gain[::-1])[::-1]  # the most that is still reached; it falls along the line
    last = np.searchsorted(-ahead, -gain, "right") - 1
    start = int(np.argmax(last - np.arange(len(gain))))
    return start, int(last[start])


@dataclass
class SeedFilter:
    """A Bloom filter of the benchmark's seeds, and which kinds of them there are."""

    kinds: list[str]
    bits: int
    table: np.ndarray

    def places(self, seeds: np.ndarray, probe: int) -> np.ndarray:
        return ((seeds ^ (seeds >> np.uint64(31))) * _ODD[probe]) >> np.uint64(64 - self.bits)

    def known(self, seeds: np.ndarray) -> np.ndarray:
        """Which of the seeds the filter knows, as indices."""
        at = np.arange(len(seeds))
        for probe in range(PROBES):
            place = self.places(seeds[at], probe)
            at = at[(self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        return at

    def suspects(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[int]]]:
        """(row, distinct known seeds) of texts that may have an overlap; seeds are made for all rows at once.

        A long item's overlap has two hits at least, any other's one.
        """
        per_row = [tokens(t) for t in texts]
        ends = np.cumsum([len(w) for w in per_row])
        h = _hashes([w for words in per_row for w in words])
        rows, known, strong = [], [], []
        for kind in self.kinds:
            seeds = _seeds(h, kind)
            at = self.known(seeds)
            row = np.searchsorted(ends, at, "right")
            inside = at + len(kind) - 1 <= ends[row] if len(at) else np.zeros(0, bool)
            rows.append(row[inside])
            known.append(seeds[at[inside]])
            strong.append(np.full(int(inside.sum()), kind[0] != "l"))
        row, known, strong = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((rows, np.int64), (known, np.uint64), (strong, bool)))
        order = np.argsort(row, kind="stable")
        row, known, strong = row[order], known[order], strong[order]
        each, first = np.unique(row, return_index=True)
        last = np.append(first[1:], len(row))[: len(each)]
        for r, lo, hi in zip(each.tolist(), first.tolist(), last.tolist(), strict=True):
            if hi - lo > 1 or strong[lo]:
                yield r, np.unique(known[lo:hi]).view(np.int64).tolist()


def _common(words: list[bytes], h: np.ndarray, own: list[bytes], own_h: np.ndarray, seeds: dict) -> tuple | None:
    """The best verified overlap (start, tokens, matched, item tokens) of a document and an item.

    Best is the one with most matches, then the earliest. ``seeds`` keeps the document's sorted
    seeds by kind for its other items.
    """
    if len(own) < MIN_ITEM:
        n = len(words) - len(own) + 1
        for at in np.flatnonzero(_seeds(h, kinds_of(len(own))[0]) == _seeds(own_h, kinds_of(len(own))[0])[0]) if n > 0 else ():
            if words[at : at + len(own)] == own:
                return int(at), len(own), len(own), len(own)
        return None
    met = np.zeros(len(words) + len(own), bool)  # diagonals, from -len(own) on
    for kind in kinds_of(len(own)):
        if kind not in seeds:
            made = _seeds(h, kind)
            order = np.argsort(made, kind="stable")
            seeds[kind] = made[order], order
        ordered, order = seeds[kind]
        mine = _seeds(own_h, kind)
        low, high = (np.searchsorted(ordered, mine, side) for side in ("left", "right"))
        for place in np.flatnonzero(high > low).tolist():
            met[order[low[place] : high[place]] - place + len(own)] = True
    best, stretches = None, {}
    padded = np.concatenate([np.zeros(len(own), np.uint64), h, np.zeros(len(own), np.uint64)])
    where = np.flatnonzero(met)
    for k in range(0, len(where), DIAGONALS):
        at = where[k : k + DIAGONALS]
        rows = np.lib.stride_tricks.sliding_window_view(padded, len(own))[at]
        for slot, same in zip(at.tolist(), rows == own_h, strict=True):
            diagonal = slot - len(own)
            first, last = max(0, -diagonal), min(len(own), len(words) - diagonal)
            same = same[first:last]
            key = (first, same.tobytes())
            if key not in stretches:  # in repetitive texts many diagonals look alike
                stretches[key] = longest_similar(same)
            start, end = stretches[key]
            matched = int(same[start:end].sum())
            begin = first + diagonal + start
            if end - start < min(MIN_OVERLAP, len(own)) or (best is not None and (matched, -begin) <= (best[2], -best[0])):
                continue
            if sum(a == b for a, b in zip(own[first + start : first + end], words[begin : begin + end - start], strict=True)) == matched:  # else a hash met by chance
                best = begin, end - start, matched, len(own)
    return best


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, text), with a number for each row."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows, "items", compact=True)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, kind), each once for an item."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = _hashes(tokens(text))
                for kind in kinds_of(len(h)):
                    seeds = np.unique(_seeds(h, kind)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array([item] * len(seeds), pa.int64()), pa.array([kind] * len(seeds))], ["seed", "item", "kind"])

    return materialize(map_texts(items.select("item", "text"), each, "seed bigint, item bigint, kind string"), "item-seeds", compact=True)


def seed_filter(item_seeds: DataFrame) -> SeedFilter | None:
    """The filter over the written table of seeds, or None without any.

    At most ``MOST_FILTER_BITS`` / 64 words and a fixed number of kinds come to the driver.
    """
    counts = {r["kind"]: r["n"] for r in item_seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    wanted = min(MOST_FILTER_BITS, max(1 << 16, FILTER_BITS * sum(counts.values())))
    made = SeedFilter(sorted(counts), (wanted - 1).bit_length(), np.zeros(0, np.uint64))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(0).to_numpy().view(np.uint64)
            place = np.unique(np.concatenate([made.places(seeds, p) for p in range(PROBES)]))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(held.view(np.int64))], ["word", "held"])

    words = map_texts(item_seeds.select("seed"), each, "word bigint, held bigint").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    made.table = np.zeros(1 << max(made.bits - 6, 0), np.uint64)
    made.table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return made


def _suspects(rows: DataFrame, text_col: str, known: SeedFilter, own: str) -> DataFrame:
    """The written table of the ``rows`` that may have an overlap, with a number for each and its known seeds."""
    sent, names = rows.sparkSession.sparkContext.broadcast(known), [*rows.columns, f"{own}_seeds"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            found = list(sent.value.suspects(utf8(batch, text_col)))
            if found:
                kept = batch.take(pa.array([r for r, _ in found]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([s for _, s in found], pa.list_(pa.int64()))], names)

    schema = T.StructType([*rows.schema.fields, T.StructField(f"{own}_seeds", T.ArrayType(T.LongType()))])
    made = map_texts(rows, each, schema)
    return materialize(made.withColumn(f"{own}_row", F.monotonically_increasing_id()), "suspects")


def _with_items(suspects: DataFrame, item_seeds: DataFrame, items: DataFrame, own: str) -> DataFrame:
    """``suspects`` with a list of the items that share a seed with each; none gives null."""
    row = f"{own}_row"
    seeds = suspects.select(row, F.explode(f"{own}_seeds").alias("seed"))
    pairs = seeds.join(item_seeds.select("seed", "item"), "seed").select(row, "item").distinct()
    lists = pairs.join(items, "item").groupBy(row).agg(F.collect_list(F.struct("item_id", "text")).alias(f"{own}_items"))
    return suspects.drop(f"{own}_seeds").join(lists, row, "left").drop(row)


def _overlaps(text: bytes | None, items: list[dict] | None) -> Iterator[tuple]:
    """(item_id, start_token, n_tokens, n_matched, item_tokens) for each of the items with a verified overlap."""
    words = tokens(text)
    h, seeds = _hashes(words), {}
    for item in items or ():
        own = tokens(item["text"])
        found = _common(words, h, own, _hashes(own), seeds)
        if found:
            yield item["item_id"], *found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item with a verified overlap, at its best place.

    (doc_id, item_id, start_token, n_tokens, n_matched, item_tokens). Null and empty texts
    have no overlap; items under ``MIN_ITEM`` tokens are found word for word only. Repeated
    documents or items give repeated rows. An empty table on either side gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    fields = [rows.schema["doc_id"], items.schema["item_id"], *(T.StructField(c, T.LongType()) for c in ("start_token", "n_tokens", "n_matched", "item_tokens"))]
    schema = T.StructType(fields)
    seeds = _item_seeds(items)
    known = seed_filter(seeds)
    if known is None:
        return rows.sparkSession.createDataFrame([], schema)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            lists = batch.column(2)
            found = [(r, o) for r, text in enumerate(utf8(batch, "text")) for o in _overlaps(text, lists[r].as_py())]
            if found:
                kinds = [lists.type.value_type.field(0).type, *[pa.int64()] * 4]
                ids = batch.column(0).take(pa.array([r for r, _ in found]))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*(o for _, o in found), strict=True), kinds, strict=True))], schema.names)

    listed = _with_items(_suspects(rows, "text", known, "near"), seeds, items, "near").where("near_items is not null")
    return map_texts(listed.select("doc_id", "text", "near_items"), each, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any overlap, all columns as they are.

    Rows that the filter does not suspect pass without a shuffle; suspects are judged as in
    ``contamination``.
    """
    items = _items(benchmark, item_col, item_text_col)
    seeds = _item_seeds(items)
    known = seed_filter(seeds)
    if known is None:
        return docs
    own, sent = fresh(docs, "near"), docs.sparkSession.sparkContext.broadcast(known)

    def clear(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _ in sent.value.suspects(utf8(batch, text_col))]] = False
            yield batch.filter(pa.array(keep))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            lists = batch.column(batch.num_columns - 1)
            keep = [next(_overlaps(text, lists[r].as_py()), None) is None for r, text in enumerate(utf8(batch, text_col))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    listed = _with_items(_suspects(docs, text_col, known, own), seeds, items, own)
    return map_texts(docs, clear, docs.schema).unionAll(map_texts(listed, judged, docs.schema))
