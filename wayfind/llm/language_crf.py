"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language. A word's score for a language is the sum
of the learned weights of its features: the word itself, the set of languages in whose
lexicon it is (a lexicon has the words of several sampled documents of the language), its
prefixes and suffixes of one to four letters, and its letter n-grams of one to three, all
hashed into one table. Between neighbouring words learned transition scores hold, and
forward-backward gives each word its distribution over languages. A document's language is
the one with the most expected words; the others show where it switches. A run of more than
``LONGEST`` letters, such as a sentence of a script without spaces, is several words of so
many letters, so that every letter of a text is read.

Training takes a bounded sample of labelled documents (``SAMPLE_DOCS``, the first by a hash
of id and text; of one longer than ``SAMPLE_CHARS`` code points, so many at a place that the
hash chooses) to the driver. Their words are strung together into chains that switch
language where one document ends and another begins, so that transitions are learned
from switches as well as from runs. The weights, of fixed size, and the lexicons, bounded
by the sample, go to the executors.

Forward-backward is computed in blocks of ``BLOCK`` words: products of the blocks' matrices
first, then the vectors between blocks along each document, then all words of all blocks at
once. That is exact for texts of any length and needs no Python step for each word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.batches import by_bytes, map_texts

#: Labelled documents that training takes, code points of each at most, and words of each chain.
SAMPLE_DOCS = 800
SAMPLE_CHARS = 20_000
CHAIN = 64
#: Sampled documents of a language that a word of its lexicon is in at least.
LEXICON_DOCS = 3
FEATURES = 1 << 17
ROUNDS = 25
PENALTY = 2e-6
BLOCK = 32
LONGEST = 24
#: Bytes of text whose words are scored at once; each word takes some hundred bytes then.
BATCH = 2 << 20
#: Words whose scores a task keeps for its next batches.
KEPT_WORDS = 200_000
UNDETERMINED = "und"

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


# --- features -----------------------------------------------------------------------------


def words_of(text: str | None) -> list[str]:
    """Lower-cased words reduced to their letters, cut at ``LONGEST``; words without a letter are left out."""
    if not text:
        return []
    lower = text.lower()
    if lower.isascii():
        words = lower.translate(_ASCII_LETTERS).split()
    else:
        words = "".join([c if c.isalpha() else _GAP.get(c, "") for c in lower]).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]


_GAP = dict.fromkeys(" \t\n\v\f\r", " ")
_ASCII_LETTERS = {k: (chr(k) if chr(k).isalpha() else _GAP.get(chr(k))) for k in range(128)}


def _letters(types: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded to ``LONGEST``."""
    size = np.fromiter(map(len, types), np.int64, len(types))
    grid = np.zeros((len(types), LONGEST), np.uint64)
    flat = np.frombuffer("".join(types).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(types)), size)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return grid, size


def _mix(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    h = (h ^ np.uint64(x) if np.isscalar(x) else h ^ x) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


def lexicons(docs: list[tuple[int, list[str]]]) -> dict[str, int]:
    """For each word in a lexicon, a number of the set of languages in whose lexicons it is."""
    seen = Counter((w, y) for y, words in docs for w in set(words))
    sets: dict[str, list[int]] = {}
    for (w, y), n in sorted(seen.items()):
        if n >= LEXICON_DOCS:
            sets.setdefault(w, []).append(y)
    number: dict[tuple[int, ...], int] = {}
    return {w: number.setdefault(tuple(ys), len(number) + 1) for w, ys in sets.items()}


def features(types: list[str], lexicon: dict[str, int]) -> list[np.ndarray]:
    """Hashed feature columns of each word; FEATURES stands for none."""
    grid, size = _letters(types)
    last = grid[np.arange(len(types))[:, None], np.maximum(size[:, None] - 1 - np.arange(LONGEST), 0)] if types else grid
    columns = []

    def keep(h: np.ndarray, where: np.ndarray) -> None:
        columns.append(np.where(where, (h >> np.uint64(20)) % np.uint64(FEATURES), np.uint64(FEATURES)).astype(np.int32))

    whole = np.full(len(types), 11, np.uint64)
    for k in range(LONGEST):
        whole = np.where(k < size, _mix(whole, grid[:, k]), whole)
    keep(whole, size > 0)
    listed = np.fromiter((lexicon.get(w, 0) for w in types), np.uint64, len(types))
    keep(_mix(np.full(len(types), 53, np.uint64), listed), listed > 0)
    for letters, kind in ((grid, 23), (last, 37)):
        h = np.full(len(types), kind, np.uint64)
        for k in range(4):
            h = _mix(h, letters[:, k])
            keep(h, size > k)
    h = [np.full((len(types), LONGEST), 41 + n, np.uint64) for n in range(3)]
    for n in range(3):
        width = LONGEST - n
        g = h[n][:, :width]
        for k in range(n + 1):
            g = _mix(g, grid[:, k : k + width])
        for k in range(width):
            if (size > k + n).any():
                keep(g[:, k], size > k + n)
    return columns


def _by_word(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words in a row, without those that a word has not, and where each word's begin."""
    grid = np.stack(columns, 1)
    there = grid < FEATURES
    size = there.sum(1)
    return grid[there], np.cumsum(size) - size


def _scores(held: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[held], starts, 0)


# --- forward-backward ---------------------------------------------------------------------


def marginals(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each word's distribution over labels; ``starts`` are the first words of the texts.

    ``scores`` and ``trans`` are logarithms; every text begins with equal odds.
    """
    n, labels = scores.shape
    if not n:
        return scores
    emit = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(trans - trans.max())
    sizes = np.diff(np.append(starts, n))
    blocks = -(-sizes // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(starts)), blocks)
    within = np.arange(len(text)) - first_block[text]
    begin = starts[text] + within * BLOCK
    length = np.minimum(BLOCK, sizes[text] - within * BLOCK)
    at = begin[:, None] + np.arange(BLOCK)
    real = np.arange(BLOCK) < length[:, None]
    e = np.where(real[:, :, None], emit[np.minimum(at, n - 1)], 1.0)

    product = np.broadcast_to(np.eye(labels), (len(text), labels, labels)).copy()
    for k in range(BLOCK):
        moved = (product @ step) * e[:, k, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        product = np.where(real[:, k, None, None], moved, product)

    enter = np.ones((len(text), labels))
    leave = np.ones((len(text), labels))
    for k in range(int(blocks.max())):  # along the texts, all texts at once
        now = first_block[blocks > k + 1] + k
        nxt = np.einsum("bi,bij->bj", enter[now], product[now])
        enter[now + 1] = nxt / nxt.max(1, keepdims=True)
    for k in range(int(blocks.max()) - 1, 0, -1):
        now = first_block[blocks > k] + k
        prev = np.einsum("bij,bj->bi", product[now], leave[now])
        leave[now - 1] = prev / prev.max(1, keepdims=True)

    forward = np.empty((len(text), BLOCK, labels))
    a = enter
    for k in range(BLOCK):
        a = np.where(real[:, k, None], (a @ step) * e[:, k], a)
        a = a / a.max(1, keepdims=True)
        forward[:, k] = a
    b = leave
    for k in range(BLOCK - 1, -1, -1):
        forward[:, k] *= b
        b = np.where(real[:, k, None], (b * e[:, k]) @ step.T, b)
        b = b / b.max(1, keepdims=True)
    p = forward[real]
    return p / p.sum(1, keepdims=True)


# --- training -----------------------------------------------------------------------------


class Model:
    """Labels, feature weights, transition scores and lexicons."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.trans, self.lexicon = labels, weights, trans, lexicon

    def score_types(self, types: list[str]) -> np.ndarray:
        return _scores(*_by_word(features(types, self.lexicon)), self.weights) if types else np.zeros((0, len(self.labels)))


class WordScores:
    """Scores of words for a run of batches: words that were met before keep theirs."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.table = np.zeros((0, len(model.labels)))

    def of(self, words: list[str]) -> np.ndarray:
        """One row for each of the words."""
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if len(self.row) + len(new) > KEPT_WORDS and self.row:
            self.__init__(self.model)
            new = list(dict.fromkeys(words))
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.score_types(new)])
        return self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]


def _expected(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, CHAIN, labels) and summed expected transitions of equal chains.

    Odds are scaled at every word, which changes neither.
    """
    length = scores.shape[1]
    emit, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(trans - trans.max())
    fwd, bwd = np.empty_like(emit), np.ones_like(emit)
    fwd[:, 0] = emit[:, 0]
    for k in range(1, length):
        now = (fwd[:, k - 1] @ step) * emit[:, k]
        fwd[:, k] = now / now.sum(1, keepdims=True)
    moves = np.zeros_like(trans)
    for k in range(length - 2, -1, -1):
        after = emit[:, k + 1] * bwd[:, k + 1]
        before = after @ step.T
        bwd[:, k] = before / before.sum(1, keepdims=True)
        both = (fwd[:, k] * before).sum(1, keepdims=True)
        moves += step * ((fwd[:, k] / both).T @ after)
    node = fwd * bwd
    return node / node.sum(2, keepdims=True), moves


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model from (text, language) rows; None if no text has a word."""
    docs = [(lang, words) for text, lang in texts if (words := words_of(text))]
    labels = sorted({lang for lang, _ in docs})
    if not labels:
        return None
    if len(labels) == 1:
        return Model(labels, np.zeros((FEATURES, 1)), np.zeros((1, 1)), {})
    rng, number = np.random.default_rng(seed), {lang: k for k, lang in enumerate(labels)}
    pieces = [(number[lang], words[k : k + CHAIN // 2]) for lang, words in docs for k in range(0, len(words), CHAIN // 2)]
    order = rng.permutation(len(pieces))
    stream = [(y, w) for k in order for y, piece in (pieces[k],) for w in piece]
    stream += [stream[k % len(stream)] for k in range(-len(stream) % CHAIN)]
    types = sorted({w for _, w in stream})
    index = {w: k for k, w in enumerate(types)}
    token = np.fromiter((index[w] for _, w in stream), np.int64, len(stream))
    gold = np.fromiter((y for y, _ in stream), np.int64, len(stream))
    lexicon = lexicons([(number[lang], words) for lang, words in docs])
    (held, starts), n_labels = _by_word(features(types, lexicon)), len(labels)
    of_word = np.repeat(np.arange(len(types)), np.diff(np.append(starts, len(held))))
    gold_moves = np.zeros((n_labels, n_labels))
    chained = gold.reshape(-1, CHAIN)
    np.add.at(gold_moves, (chained[:, :-1].ravel(), chained[:, 1:].ravel()), 1)
    weights, trans = np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels))
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    total = len(stream)
    for _ in range(ROUNDS):  # full-batch AdaGrad: the same rows give the same weights
        node, moves = _expected(_scores(held, starts, weights)[token].reshape(-1, CHAIN, n_labels), trans)
        error = node.reshape(-1, n_labels)
        error[np.arange(total), gold] -= 1
        by_type = np.stack([np.bincount(token, error[:, y], len(types)) for y in range(n_labels)], 1)
        gradient = PENALTY * total * weights
        for y in range(n_labels):
            gradient[:, y] += np.bincount(held, by_type[of_word, y], FEATURES)
        gradient_t = moves - gold_moves
        seen_w += gradient**2
        seen_t += gradient_t**2
        weights -= 0.4 * gradient / np.sqrt(seen_w)
        trans -= 0.4 * gradient_t / np.sqrt(seen_t)
    return Model(labels, weights, trans, lexicon)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from at most ``sample_docs`` of the labelled rows, the first by hash of id and text.

    Repeated rows may all be sampled; null ids are like any other. None if there is nothing to learn from.
    """
    text = F.col(text_col).cast("string")
    h = F.xxhash64(F.col(id_col).cast("string"), text)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    pieces = F.ceil(F.length(text) / SAMPLE_CHARS).cast("int")
    part = F.when(pieces > 1, F.substr(text, F.pmod(h, pieces).cast("int") * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS))).otherwise(text)
    chosen = rows.select(h.alias("h"), part.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    first = lambda df: df.orderBy("h", "text", "lang").limit(sample_docs).collect()
    n, few = rows.count(), []
    if n > 2 * sample_docs:  # a share of the hashes holds the first ones, unless many rows are equal
        share = int(2**63 * (2 * min(1.0, 1.5 * sample_docs / n) - 1))
        few = first(chosen.where(F.col("h") <= share))
    if len(few) < min(n, sample_docs):
        few = first(chosen)
    return fit([(r["text"], r["lang"]) for r in few])


# --- prediction ---------------------------------------------------------------------------


def predict_batch(texts: list[str | None], scores: WordScores) -> list[tuple[str, float, list[float]]]:
    """Language, its share of the expected words, and all shares, for each text."""
    per_text, model = [words_of(t) for t in texts], scores.model
    sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    out: list[tuple[str, float, list[float]]] = [(UNDETERMINED, 0.0, [0.0] * len(model.labels))] * len(texts)
    if len(some):
        p = marginals(scores.of([w for words in per_text for w in words]), starts, model.trans)
        share = np.add.reduceat(p, starts, 0) / sizes[some, None]
        for k, s in zip(some.tolist(), share, strict=True):
            out[k] = (model.labels[int(s.argmax())], float(min(1.0, s.max())), s.tolist())
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, shares map<lang,double>) for each row, from its text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text where
    nothing could be learned. Repeated rows are judged alike; empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,double>").alias("shares"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scores = sent.value, WordScores(sent.value)
        for batch in by_bytes(batches, "text", BATCH):
            made = predict_batch(batch.column(1).to_pylist(), scores)
            shares = pa.array([list(zip(own.labels, s, strict=True)) for _, _, s in made], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lang for lang, _, _ in made], pa.string()), pa.array([s for _, s, _ in made], pa.float64()), shares],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    return map_texts(rows, each, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")
