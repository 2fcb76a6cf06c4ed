"""Quality rules: counting rules, then the divergence of a text from its language.

Every text gives two kinds of histogram: its characters by class, and its common words
for each language that has a list below (all other words fall into one last bin). A first
pass sums them over all documents of a language that are long enough and not largely
symbols or capitals, which makes that language's references; only those few sums reach the driver. A
second pass compares each text with the references by Jensen-Shannon distance (the square
root of the divergence to base 2, from 0 to 1). A text is judged by the language whose
common words it fits best, so a wrong label does no harm, unless it names a language
without a reference: such texts are judged by the counting rules alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.batches import by_bytes, map_texts, utf8

WINDOW = 5

# Frequent function words by language.
COMMON_WORDS = {
    "de": "aber als am an auch auf aus bei das dem den der des die durch ein eine einer er es für hat ich im in ist mit nach nicht noch oder sein sich sie sind so über um und von war wie wird zu zum zur",
    "en": "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you",
    "es": "a al como con de del el en entre es esta este ha la las lo los más me no o para pero por que se ser si sin sobre su sus también un una y",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous",
}

# The characters of each class; letters outside ASCII and all else follow.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\v\f\r",
    "stop": b".,;:?'\"()-",
    "mark": b"!",
    "symbol": b"#*$%&|<>",
}
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
#: First bytes of code points other than white space.
_PRINTED = bytes(b for b in range(256) if b not in SPACE and not 0x80 <= b < 0xC0)

#: Fewer words than this are too few to compare, whatever their histograms.
MIN_JUDGED_WORDS = 40
#: A text with more symbols, or more capitals among its characters, is no reference.
MAX_REFERENCE_SYMBOLS = 0.01
MAX_REFERENCE_UPPER = 0.2
#: Squared distances above these are not a language's usual text. A histogram of n samples is
#: away from its own source by about bins / n, so a share of that is added for n words.
MAX_CLASS_DISTANCE = 0.16
MAX_WORD_DISTANCE = 0.23
CLASS_NOISE = 2.6
WORD_NOISE = 4.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _class_matrix() -> np.ndarray:
    """256 bytes by classes; lead bytes of other code points are letters, continuation bytes count nowhere."""
    grid = np.zeros((256, len(CLASSES) + 2), np.int64)
    for k, chars in enumerate(CLASSES.values()):
        grid[list(chars), k] = 1
    grid[0xC0:, len(CLASSES)] = 1
    grid[:0x80, len(CLASSES) + 1] = grid[:0x80].sum(1) == 0
    return grid


CLASS_OF = _class_matrix()
_ONLY_WORDS = bytes.maketrans(CLASSES["stop"] + b"!" + SYMBOLS, b" " * (len(CLASSES["stop"]) + 1 + len(SYMBOLS)))
LANGS = sorted(COMMON_WORDS)
_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
_WORD_ID = {w.encode(): k + 1 for k, w in enumerate(_VOCABULARY)}
_LISTED = {lang: np.array([_WORD_ID[w.encode()] for w in sorted(set(words.split()))]) for lang, words in COMMON_WORDS.items()}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[tuple[bytes, ...], list[int]] = {}
    for k in np.flatnonzero(maybe):  # equal hashes are compared as words
        seen.setdefault(tuple(words[k : k + window]), []).append(k)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(covered, places, 1)
            np.add.at(covered, np.array(places) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def byte_counts(text: bytes | None) -> np.ndarray:
    return np.bincount(np.frombuffer(text or b"", np.uint8), minlength=256)


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the byte histogram."""
    text = text or b""
    words = text.split()
    seen = byte_counts(text)
    lines = [line for line in text.split(b"\n") if line.strip(SPACE)]
    return len(words), int(seen[list(_PRINTED)].sum()), int(seen[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), seen


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def word_counts(text: bytes | None) -> np.ndarray:
    """How often each word of all lists occurs; bin 0 has the words of none."""
    words = (text or b"").translate(_ONLY_WORDS).lower().split()
    get = _WORD_ID.get
    return np.bincount(np.fromiter((get(w, 0) for w in words), np.int64, len(words)), minlength=len(_VOCABULARY) + 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    half = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return float(np.sqrt(max(0.0, (half(p) + half(q)) / 2)))


def _of_language(counts: np.ndarray, lang: str) -> np.ndarray:
    listed = counts[_LISTED[lang]]
    return np.append(listed, counts.sum() - listed.sum())


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and common-word histograms of each listed language over all its documents.

    Left out are documents that are too short to judge, or largely symbols or capitals. At most one row for each language and bin comes to the driver.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isin(LANGS))
    width, classes = len(_VOCABULARY) + 1, CLASS_OF.shape[1]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(width + classes, np.int64) for lang in LANGS}
        for batch in by_bytes(batches, "text"):
            for text, lang in zip(utf8(batch, "text"), batch.column(1).to_pylist(), strict=True):
                seen, words = byte_counts(text), word_counts(text)
                chars, symbols, upper = (int(seen[list(x)].sum()) for x in (_PRINTED, SYMBOLS, CLASSES["upper"]))
                if words.sum() >= MIN_JUDGED_WORDS and symbols <= MAX_REFERENCE_SYMBOLS * chars and upper <= MAX_REFERENCE_UPPER * chars:
                    sums[lang] += np.concatenate([words, seen @ CLASS_OF])
        for lang, total in sums.items():
            if total.any():
                bins = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins), pa.array(total[bins])], ["lang", "bin", "n"])

    found: dict[str, np.ndarray] = {}
    for lang, k, n in map_texts(rows, each, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n")).collect():
        found.setdefault(lang, np.zeros(width + classes))[k] = n
    return {lang: (total[width:], _of_language(total[:width], lang)) for lang, total in sorted(found.items())}


def distances(text: bytes | None, refs: dict[str, tuple[np.ndarray, np.ndarray]], seen: np.ndarray) -> tuple[str | None, float, float]:
    """The language of best fit, and the distances of classes and of common words to it."""
    words, classes = word_counts(text), seen @ CLASS_OF
    best = min(((js_distance(_of_language(words, lang), ref), lang) for lang, (_, ref) in refs.items()), default=None)
    if best is None:
        return None, 0.0, 0.0
    return best[1], js_distance(classes, refs[best[1]][0]), best[0]


def too_far(n_words: int, by_class: float, by_word: float) -> bool:
    """Whether a text of so many words is further from its language than chance takes it."""
    n = max(n_words, 1)
    return by_class**2 > MAX_CLASS_DISTANCE**2 + CLASS_NOISE / n or by_word**2 > MAX_WORD_DISTANCE**2 + WORD_NOISE / n


def _judge(text: bytes | None, lang: str | None, refs: dict) -> tuple:
    n, chars, symbols, dup, repeats, seen = base_counts(text)
    failed = base_failed(n, repeats)
    fits, by_class, by_word = distances(text, refs, seen)
    judged = n >= MIN_JUDGED_WORDS and (lang is None or lang in refs)
    odd = judged and too_far(n, by_class, by_word)
    return n, chars, symbols, dup, repeats, failed, not failed and not odd, fits, by_class, by_word


FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, fits_lang string, class_distance double, word_distance double"


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: counts, base verdict, distances and the final verdict.

    A null text counts as empty and fails. Texts under ``MIN_JUDGED_WORDS`` words, and those
    whose language has no reference, are judged by the counting rules alone. No reference at
    all (an empty table, no listed language) leaves the counting rules too.
    """
    refs = references(docs, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIELDS}"
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
    names = ["doc_id", *(x.split()[0] for x in FIELDS.split(", "))]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            made = [_judge(t, lang, refs) for t, lang in zip(utf8(batch, "text"), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names)

    return map_texts(rows, each, schema)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole and in one pass after the references."""
    refs, names = references(docs, text_col, lang_col), docs.columns
    at, lang_at = names.index(text_col), names.index(lang_col)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            keep = [_judge(t, lang, refs)[6] for t, lang in zip(utf8(batch, names[at]), batch.column(lang_at).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, each, docs.schema)
