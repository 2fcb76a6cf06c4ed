"""Passages that an earlier document has already: found by suffix order, cut out byte by byte.

A byte of a text goes if a stretch of ``min_length`` bytes over it also starts in a document
with a smaller id. Which stretches are equal is read off a Burrows-Wheeler transform by
threshold-bounded interval expansion: breadth-first, every interval of suffixes that share a
prefix is extended backward by each byte before it, which cuts the suffix order where common
prefixes have length 0, 1, 2 and so on; after ``min_length`` rounds the suffixes between two
cuts share at least so many bytes, and the least document of each such class decides.

One transform of all texts would be one task's work, so suffixes are dealt out by content:

* Every window of ``min_length`` bytes has an **anchor**, the least hash of the byte grams in
  it. Windows that follow each other mostly share it, so a text becomes a row of short
  **strings**, one for each run of windows with one anchor; equal windows have equal anchors,
  wherever they are. Runs end at ``MAX_RUN`` windows, so that periodic texts do not add up.
* Batches of documents send the anchors they have, sorted and packed by hash range, and get
  those back that a second document has too. All else cannot repeat and is never moved.
* Of the anchors they got back, batches send each different string once, packed and compressed
  by bucket of anchors; all copies of a window meet in one bucket, whose transforms are expanded
  there, and the answer goes back to the batch, which keeps where it has its strings.
* An anchor with more than ``HOT_RUNS`` runs is split: each of its windows is a string of its
  own, dealt out by its bytes. So a bucket holds a hot string once for each batch, not document.

Between the steps are Parquet tables in the shared folder, so a lost executor costs its tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.batches import by_bytes, map_texts, utf8
from wayfind.storage import materialize, release

MIN_LENGTH = 50
MAX_RUN = 256
BATCH_BYTES = 8 << 20
BLOCK_BYTES = 128 << 10
BUCKET_BYTES = 4 << 20
HOT_RUNS = 1 << 14
#: Transforms of a bucket of strings, and the bytes of strings, copies of other batches included, for one.
TRANSFORMS, TRANSFORM_BYTES = 4, 512 << 10

#: No byte of UTF-8: it ends every string of a transform.
END = 0xFF
# Odd 64-bit multipliers of the hash of a gram.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def gram_of(min_length: int) -> int:
    """Bytes of a gram: a multiple of eight, about half a window."""
    if min_length < 8:
        raise ValueError("min_length must be 8 at least")
    return 8 * max(1, min_length // 16)


def words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), dtype=f"{order}u8", buffer=data, strides=(1,)).astype(np.uint64)


def anchors(data: np.ndarray, min_length: int) -> np.ndarray:
    """The anchor of the window that starts at each place of ``data`` (uint8)."""
    gram = gram_of(min_length)
    words, n = words_at(data), len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        h += words[k : k + n]
        h *= MULTIPLIERS[k // 8 % 2]
        h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[2]
    h ^= h >> np.uint64(32)
    width, reach = min_length - gram + 1, 1
    while reach < width:  # minima over 2, 4, 8 ... grams, the last step overlapping
        step = min(reach, width - reach)
        h = np.minimum(h[:-step], h[step:])
        reach += step
    return h


def runs(pieces: list[tuple[int, int, bytes]], min_length: int) -> tuple[np.ndarray, ...]:
    """(piece, place in the piece, windows, anchor) of each run of windows with one anchor."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    if not len(data) or sizes.max() < min_length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    ends = np.cumsum(sizes)
    least = anchors(data, min_length)
    changes = np.flatnonzero(least[1:] != least[:-1]) + 1
    at = np.union1d(changes, (ends - sizes)[sizes >= min_length])
    piece = np.searchsorted(ends, at, "right")
    stop = ends[piece] - min_length + 1  # of the piece's windows
    whole = at < stop
    windows = (np.minimum(np.append(at[1:], len(least)), stop) - at)[whole]
    at, piece = at[whole], piece[whole]
    cuts = -(-windows // MAX_RUN)
    if cuts.max() > 1:
        step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at, piece, windows = np.repeat(at, cuts) + step * MAX_RUN, np.repeat(piece, cuts), np.minimum(np.repeat(windows, cuts) - step * MAX_RUN, MAX_RUN)
    return piece, at - (ends - sizes)[piece], windows, least[at]


def blocks(texts: Iterable[tuple[int, bytes]], min_length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (key, offset, bytes) of about ``BLOCK_BYTES``; longer texts in overlapping pieces."""
    held, size = [], 0
    for key, text in texts:
        for offset in range(0, max(1, len(text) - min_length + 1), BLOCK_BYTES):
            piece = text[offset : offset + BLOCK_BYTES + min_length - 1]
            if len(piece) < min_length:
                continue
            held.append((key, offset, piece))
            size += len(piece)
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _rows(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple]:
    """The rows as tuples, one slice of about a block in memory."""
    for batch in by_bytes(batches, text):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


# --- transform -----------------------------------------------------------------------------


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``data`` in the order of the ``depth`` bytes (at least) that follow each."""
    n, bits = len(data), np.uint64(21)
    key, reach = words_at(np.concatenate([data, np.full(7, END, np.uint8)]), ">"), 8
    order = np.argsort(key)
    ordered = key[order]
    while reach < depth:
        rank = np.full(n + reach, n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        if n < 1 << 21:  # two ranks and the place fit one number
            key = np.sort(((rank[:n] << bits | rank[reach:]) << bits) | np.arange(n, dtype=np.uint64))
            order, ordered = (key & np.uint64((1 << 21) - 1)).astype(np.int64), key >> bits
        else:
            key = (rank[:n] << np.uint64(32)) | rank[reach:]
            order = np.argsort(key)
            ordered = key[order]
        reach *= 2
    return order


def prefix_cuts(data: np.ndarray, order: np.ndarray, min_length: int) -> np.ndarray:
    """True where a suffix and the one before it in ``order`` share less than ``min_length`` bytes.

    ``order`` needs to hold for ``min_length`` bytes only: intervals of prefixes no longer than
    that are the same, and so are the counts of bytes before them.
    """
    n = len(data)
    before = data[order - 1]  # the transform; place 0 has an end before it
    column = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix that is one byte longer is in the order
    back[column] = np.arange(n)
    same = before[column[1:]] == before[column[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[column[:-1][same]] = column[1:][same]
    previous[column[1:][same]] = column[:-1][same]
    inside = before != END
    cut = np.zeros(n + 1, bool)
    cut[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])  # the interval of the empty prefix
    for length in range(min_length):
        sizes = high - low + 1
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
        if length:  # nothing is extended over the end of a string, but ends are a prefix too
            keep = inside[at]
            at, owner = at[keep], owner[keep]
        least = np.sort(back[at[previous[at] < low[owner]]])
        most = np.sort(back[at[following[at] > high[owner]]])
        new = ~cut[most + 1]
        low, high = least[new], most[new]
        if not len(low):
            break
        cut[high + 1] = True
    return cut[:n]


def least_documents(strings: list[bytes], docs: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, least) of each window of each string: the least document that has it."""
    data = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings])
    order = suffix_order(data, min_length)
    classes = np.flatnonzero(prefix_cuts(data, order, min_length))
    of_string = np.repeat(np.arange(len(strings)), sizes)
    least = np.minimum.reduceat(docs[of_string[order]], classes)
    found = np.empty(len(data), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(classes, len(data))))
    place = np.arange(len(data)) - (np.cumsum(sizes) - sizes)[of_string]
    windows = place < sizes[of_string] - min_length
    return of_string[windows], place[windows], found[windows]


# --- stages --------------------------------------------------------------------------------


def _batched(docs: DataFrame) -> DataFrame:
    """(batch, row, doc_id, n_bytes, text): the documents in batches of some megabytes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number, row = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in by_bytes(batches, "text"):
            texts = utf8(batch, "text")
            sizes, numbers = [len(t or b"") for t in texts], []
            for size in sizes:
                if held and held + size > BATCH_BYTES:
                    held, number = 0, number + 1
                held += size
                numbers.append(part + number)
            rows = pa.array(range(part + row, part + row + len(texts)), pa.int64())
            row += len(texts)
            columns = [pa.array(numbers, pa.int64()), rows, batch.column(0), pa.array(sizes, pa.int64()), pa.array([t or b"" for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "row", "doc_id", "n_bytes", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, cut, "batch long, row long, doc_id long, n_bytes long, text binary")


def packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _record(names: Sequence[str], columns: Iterable) -> pa.RecordBatch:
    """A batch of columns of whole numbers or bytes."""
    arrays = [pa.array(c, pa.binary() if len(c) and isinstance(c[0], bytes) else pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _asked(texts: DataFrame, buckets: int, min_length: int) -> DataFrame:
    """(bucket, batch, anchors, tally): the anchors of each batch, sorted and cut by hash range.

    ``anchors`` packs numbers of 64 bits; ``tally`` has 16 bits for each: twice the runs that the
    batch has of it, and one more if two documents have it.
    """

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            keys, rows = (np.concatenate(x) for x in zip(*held, strict=True)) if held else ([], [])
            if not len(keys):
                return
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            several = np.maximum.reduceat(rows, first) != np.minimum.reduceat(rows, first)
            tally = (2 * np.minimum(np.diff(np.append(first, len(keys))), (1 << 15) - 1) + several).astype(np.uint16)
            keys = keys[first]
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
            spans = list(zip(at, [*at[1:], len(keys)], strict=True))
            columns = [bucket[at].tolist(), [batch_of] * len(at), [keys[a:b].tobytes() for a, b in spans], [tally[a:b].tobytes() for a, b in spans]]
            yield _record(["bucket", "batch", "anchors", "tally"], columns)

        def rows_of(group: list[tuple[int, bytes]]) -> None:
            for pieces in blocks(group, min_length):
                piece, _, _, keys = runs(pieces, min_length)
                held.append((keys, np.array([p[0] for p in pieces])[piece]))

        group, size = [], 0
        for batch, row, text in _rows(batches):
            if batch != batch_of or size > BLOCK_BYTES:
                rows_of(group)
                group, size = [], 0
            if batch != batch_of:
                yield from told()
                batch_of, held = batch, []
            group.append((row, text))
            size += len(text)
        rows_of(group)
        yield from told()

    rows = texts.where(f"doc_id is not null and n_bytes >= {min_length}").select("batch", "row", "text")
    return map_texts(rows, ask, "bucket long, batch long, anchors binary, tally binary")


def _answered(asked: DataFrame) -> DataFrame:
    """(batch, n, anchors, hot): of the anchors of each batch those that more than one document has, and a byte for each."""

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in table["anchors"].to_pylist()]
        keys = np.concatenate(lists)
        tally = np.frombuffer(b"".join(table["tally"].to_pylist()), np.uint16)
        order = np.argsort(keys, kind="stable")
        ordered, tally = keys[order], tally[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(keys)))
        shared = (sizes > 1) | (np.maximum.reduceat(tally & 1, starts) > 0)
        hot = np.add.reduceat(tally >> 1, starts, dtype=np.int64) > HOT_RUNS
        state = np.empty(len(keys), np.uint8)  # 0: no other document, 1: shared, 2: hot too
        state[order] = np.repeat(shared.astype(np.uint8) * (1 + hot), sizes)
        states = np.split(state, np.cumsum([len(x) for x in lists])[:-1])
        kept = [x[f > 0].tobytes() for x, f in zip(lists, states, strict=True)]
        marks = [(f[f > 0] == 2).astype(np.uint8).tobytes() for f in states]
        return pa.table({"batch": table["batch"], "n": pa.array([len(m) for m in marks], pa.int64()), "anchors": pa.array(kept, pa.binary()), "hot": pa.array(marks, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(answer, "batch long, n long, anchors binary, hot binary").where("n > 0")


def _with_texts(told: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """For each batch first the rows of ``told`` (batch, a, b, c), then its documents, as (batch, kind, row, doc_id, a, b, c)."""
    none = F.lit(None)
    left = told.select("batch", F.lit(0).alias("kind"), none.cast("long").alias("row"), none.cast("long").alias("doc_id"), "a", "b", "c")
    right = texts.select("batch", F.lit(1).alias("kind"), "row", "doc_id", F.col("text").alias("a"), none.cast("binary").alias("b"), none.cast("binary").alias("c"))
    return left.unionAll(right).repartition(parts, "batch").sortWithinPartitions("batch", "kind")


class _Strings:
    """The different strings of one batch, and where the batch has each."""

    FIELDS = ("bucket", "batch", "size", "texts", "sizes", "least", "sub", "n_places", "places")
    SCHEMA = "bucket long, batch long, size long, texts binary, sizes binary, least binary, sub binary, n_places long, places binary"

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def add(self, text: bytes, key: int, row: int, doc: int, start: int) -> None:
        if (seen := self.known.get(text)) is None:
            seen = self.known[text] = (key, [], [], [])
        seen[1].append(row)
        seen[2].append(doc)
        seen[3].append(start)

    def told(self, batch: int | None) -> Iterator[pa.RecordBatch]:
        """One row for each bucket: strings packed with their sizes, least documents and transforms, and their places apart."""
        if not self.known:
            return
        texts, found = list(self.known), list(self.known.values())
        slot = np.array([f[0] for f in found], np.uint64) * MULTIPLIERS[0] >> np.uint64(32)
        slot = (slot * np.uint64(self.buckets * TRANSFORMS) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        cuts = np.flatnonzero(np.diff(slot[order] // TRANSFORMS)) + 1
        rows = []
        for mine in np.split(order, cuts):
            said, held = [texts[k] for k in mine.tolist()], [found[k] for k in mine.tolist()]
            counts = np.array([len(f[1]) for f in held], np.int64)
            places = np.concatenate([counts, *(np.array([x for f in held for x in f[k]], np.int64) for k in (1, 2, 3))])
            data = b"".join(said)
            least = np.array([min(f[2]) for f in held], np.int64)
            sub = (slot[mine] % TRANSFORMS).astype(np.uint8)
            sizes = np.array([len(t) for t in said], np.uint32)
            rows.append((int(slot[mine[0]]) // TRANSFORMS, batch, len(data), packed(data), sizes.tobytes(), packed(least.tobytes()), sub.tobytes(), int(counts.sum()), packed(places.tobytes())))
        self.known = {}
        yield _record(self.FIELDS, zip(*rows, strict=True))


def _candidates(texts: DataFrame, answers: DataFrame, parts: int, buckets: int, min_length: int) -> DataFrame:
    """The strings whose anchor repeats, of every batch, by bucket, as ``_Strings`` packs them."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of, known, strings = None, [], _Strings(buckets)

        def search(group: list[tuple[tuple[int, int], bytes]]) -> None:
            if not (known and group):
                return
            if len(known) > 1:
                keys, hot = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(keys)
                known[:] = [(keys[order], hot[order])]
            wanted, hot = known[0]
            for pieces in blocks(group, min_length):
                piece, place, windows, keys = runs(pieces, min_length)
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                hit = wanted[at] == keys
                for k, a, n, key, split in zip(piece[hit].tolist(), place[hit].tolist(), windows[hit].tolist(), keys[hit].tolist(), hot[at[hit]].tolist(), strict=True):
                    (row, doc), offset, data = pieces[k]
                    if split:
                        for b in range(a, a + n):
                            text = data[b : b + min_length]
                            strings.add(text, xxhash.xxh64_intdigest(text), row, doc, offset + b)
                    else:
                        strings.add(data[a : a + n + min_length - 1], key, row, doc, offset + a)

        group, size = [], 0
        for batch, kind, row, doc, data, marks, _ in _rows(batches, "a"):
            if batch != batch_of or size > BLOCK_BYTES:
                search(group)
                group, size = [], 0
            if batch != batch_of:
                yield from strings.told(batch_of)
                batch_of, known = batch, []
            if kind == 0:
                order = np.frombuffer(data, np.uint64)
                known.append((order, np.frombuffer(marks, np.uint8)))
            elif doc is not None and len(data) >= min_length:
                group.append(((row, doc), data))
                size += len(data)
        search(group)
        yield from strings.told(batch_of)

    told = answers.select("batch", F.col("anchors").alias("a"), F.col("hot").alias("b"), F.lit(None).cast("binary").alias("c"))
    return map_texts(_with_texts(told, texts, parts), find, _Strings.SCHEMA)


def _expanded(strings: DataFrame, min_length: int) -> DataFrame:
    """(bucket, batch, least, n_early, early): for each string of a batch the least document that has it, and earlier windows.

    ``least`` packs a number for each string; ``early`` the number of runs of windows that a
    smaller document than ``least`` has, for each string, then their first and their last but one.
    """

    def expand(table: pa.Table) -> pa.Table:
        number, texts, subs, docs, rows = {}, [], [], [], []
        for size, data, sizes, least, sub in zip(*(table[c].to_pylist() for c in ("size", "texts", "sizes", "least", "sub")), strict=True):
            sizes, data = np.frombuffer(sizes, np.uint32), unpacked(data, size)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            mine = []
            for a, b, s, doc in zip([0, *ends], ends, sub, np.frombuffer(unpacked(least, 8 * len(sizes)), np.int64).tolist(), strict=False):
                text = data[a:b]
                if (k := number.setdefault(text, len(texts))) == len(texts):
                    texts.append(text)
                    subs.append(s)
                    docs.append(doc)
                elif doc < docs[k]:
                    docs[k] = doc
                mine.append(k)
            rows.append(np.array(mine))
        docs, subs = np.array(docs, np.int64), np.array(subs)
        of, first, last = [], [], []
        for s in np.unique(subs):
            mine = np.flatnonzero(subs == s)
            string, place, least = least_documents([texts[k] for k in mine.tolist()], docs[mine], min_length)
            early = np.concatenate([[False], least < docs[mine][string], [False]])
            ends = np.append(place[1:] == 0, True)
            opens, closes = np.flatnonzero(early[1:-1] & (~early[:-2] | (place == 0))), np.flatnonzero(early[1:-1] & (~early[2:] | ends))
            of.append(mine[string[opens]])
            first.append(place[opens])
            last.append(place[closes] + 1)
        of, first, last = (np.concatenate(x) for x in (of, first, last))
        order = np.argsort(of, kind="stable")
        of, first, last = of[order], first[order], last[order]
        counts = np.bincount(of, minlength=len(docs))
        starts = np.cumsum(counts) - counts
        leasts, totals, early = [], [], []
        for mine in rows:
            n = counts[mine]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[mine], n)
            leasts.append(packed(docs[mine].tobytes()))
            totals.append(len(at))
            early.append(packed(np.concatenate([n, first[at], last[at]]).astype(np.int64).tobytes()))
        return pa.table({"bucket": table["bucket"], "batch": table["batch"], "least": pa.array(leasts, pa.binary()), "n_early": pa.array(totals, pa.int64()), "early": pa.array(early, pa.binary())})

    rows = strings.select("bucket", "batch", "size", "texts", "sizes", "least", "sub")
    return rows.groupBy("bucket").applyInArrow(expand, "bucket long, batch long, least binary, n_early long, early binary")


def _covered(strings: DataFrame, expanded: DataFrame, min_length: int) -> DataFrame:
    """(batch, a, b, c): rows of documents and the starts and ends of what repeats cover in them, packed."""

    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, n_places, places, least, n_early, early in (r for x in batches for r in zip(*(c.to_pylist() for c in x.columns), strict=True)):
            sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
            n = len(sizes)
            least = np.frombuffer(unpacked(least, 8 * n), np.int64)
            places = np.frombuffer(unpacked(places, 8 * (n + 3 * n_places)), np.int64)
            row, doc, start = places[n:].reshape(3, n_places)
            of = np.repeat(np.arange(n), places[:n])
            early = np.frombuffer(unpacked(early, 8 * (n + 2 * n_early)), np.int64)
            counts, (first, last) = early[:n], early[n:].reshape(2, n_early)
            later, own = doc > least[of], np.flatnonzero(doc == least[of])
            runs_of = counts[of[own]]
            at = np.arange(runs_of.sum()) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of) + np.repeat((np.cumsum(counts) - counts)[of[own]], runs_of)
            own = np.repeat(own, runs_of)
            rows = np.concatenate([row[later], row[own]])
            starts = np.concatenate([start[later], start[own] + first[at]])
            ends = np.concatenate([start[later] + sizes[of[later]], start[own] + last[at] + min_length - 1])
            yield _record(["batch", "a", "b", "c"], [[batch], [rows.tobytes()], [starts.tobytes()], [ends.tobytes()]])

    right = expanded.select(F.col("bucket").alias("_k"), F.col("batch").alias("_b"), "least", "n_early", "early")
    both = strings.select("bucket", "batch", "sizes", "n_places", "places").join(right, (F.col("bucket") == F.col("_k")) & (F.col("batch") == F.col("_b")))
    return map_texts(both.select("batch", "sizes", "n_places", "places", "least", "n_early", "early"), cover, "batch long, a binary, b binary, c binary").where("length(a) > 0")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as maximal ones in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


def _kept(texts: DataFrame, covered: DataFrame, parts: int) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal removed spans of each text, and what is left."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of, known, ready, done = None, [], False, []

        def told() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in d[2]] for d in done], spans_type), pa.array([d[3] for d in done], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

        held = 0
        for batch, kind, row, doc, data, starts, ends in _rows(batches, "a"):
            if batch != batch_of:
                batch_of, known, ready = batch, [], False
            if kind == 0:
                known.append(tuple(np.frombuffer(x, np.int64) for x in (data, starts, ends)))
                continue
            if known and not ready:
                rows, starts, ends = (np.concatenate(x) for x in zip(*known, strict=True))
                order = np.argsort(rows, kind="stable")
                known = [(rows[order], starts[order], ends[order])]
            ready = True
            a, b = np.searchsorted(known[0][0], [row, row + 1]) if known else (0, 0)
            spans = merged(known[0][1][a:b], known[0][2][a:b]) if b > a else []
            kept = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)], strict=True))
            done.append((doc, len(data), spans, kept))
            held += len(data)
            if held > 8 * BLOCK_BYTES:
                yield told()
                done, held = [], 0
        if done:
            yield told()

    return map_texts(_with_texts(covered, texts, parts), cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs``: what repeats an earlier document goes.

    ``docs`` has doc_id (a whole number) and text; other columns are ignored. Texts are taken as
    UTF-8. ``spans`` are the maximal removed runs of bytes, in order, ``kept`` the bytes left, which
    need not be whole characters. A null text is empty. A row without an id is after no document
    and before none, so it stays as it is. Rows with one id do not count against each other, whether
    their texts are equal or not. Texts shorter than ``min_length`` stay whole. Very long texts
    are read in overlapping pieces. An empty table gives no rows.
    """
    cores, parts = docs.sparkSession.sparkContext.defaultParallelism, docs._jdf.rdd().getNumPartitions()
    texts = materialize(_batched(docs if parts >= cores else docs.select("doc_id", "text").repartition(cores)), "texts", codec="zstd")
    n_bytes = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # A window of n bytes has a run of its own in two of (n - gram) at most: bytes of anchors follow from bytes of text.
    buckets = 1 + 16 * n_bytes // (min_length - gram_of(min_length) + 2) // BUCKET_BYTES
    answers = materialize(_answered(_asked(texts, buckets, min_length)), "anchors")
    known = answers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = known * (min_length + (min_length - gram_of(min_length)) // 2)
    parts = max(parts, cores, n_bytes // (4 * BATCH_BYTES))
    strings = materialize(_candidates(texts, answers, parts, 1 + size // (TRANSFORMS * TRANSFORM_BYTES), min_length), "strings")
    release(answers)
    expanded = materialize(_expanded(strings, min_length), "expanded")
    covered = materialize(_covered(strings, expanded, min_length), "covered", codec="zstd")
    release(strings)
    release(expanded)
    return _kept(texts, covered, parts)
