"""Secret scans in DataFrame expressions alone.

Three fixed patterns give the base spans. Candidate strings (runs of key-like characters)
are then scanned by a sliding window for each character class: the window's Shannon
entropy is kept up to date by the counts of the one character that enters and the one
that leaves, and the stretch from the first to the last window above the class's
threshold is a span, unless the candidate or the stretch is on the allow-list, or the
stretch lies within a base span.

Positions come from splitting the text at the pattern: the lengths of the pieces and of
the matches, summed in order, are the starts. Running sums go by chunks, and texts are cut
by chunks too, so that a text with very many matches, and a match of any length, cost
about in proportion to their size. All counts are in code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.storage import fresh

# Kind, pattern, the group whose length counts, and the least length.
BASE_PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KINDS = [kind for kind, *_ in BASE_PATTERNS] + ["entropy"]
BASE = len(BASE_PATTERNS)

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Class, its characters, the window, and the bits a character must carry in it: first in
#: candidates with digits, then in those with next to none, which words come nearer to. A
#: window of w characters has log2(w) bits at most; None: the class cannot carry so many.
ENTROPY_CLASSES = [
    ("hex", _DIGITS + _UPPER[:6], 16, 3.0, None),
    ("alnum", _DIGITS + _UPPER + _LOWER, 20, 3.7, 4.0),
    ("base64", _DIGITS + _UPPER + _LOWER + "+/_=-", 24, 4.0, 4.25),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A key mixes letters and so many digits; with fewer it mixes letters of both cases.
MIN_DIGITS = 3

#: Candidates that look random but are none: UUIDs, dates and versions, paths and
#: identifiers of words. The possessive quantifier keeps the matcher from recursing.
ALLOW_LIST = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9_/+=-]+$",
    r"^/?(?:[A-Za-z]{1,19}[0-9]{0,4}[/_=+-]+)++[A-Za-z]{0,19}[0-9]{0,4}$",
]
#: A stretch with one of these is a sample, not a key.
ALLOWED_PARTS = r"EXAMPLE|example"

#: Array items, and code points of text, that are worked on at a time.
CHUNK, CUT_CHUNK = 512, 4096
_SCALE = 10**12
_SPAN = "array<struct<start:int,ord:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of the integers up to and with each, from 0 on, chunk by chunk."""
    none, zero = F.array().cast("array<int>"), F.lit(0)

    def fold(numbers: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return _let(combine(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

        return F.aggregate(numbers, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def by_chunks(v: Column) -> Column:
        starts = F.sequence(zero, F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        chunks = F.transform(starts, lambda k: F.slice(v, k * CHUNK + 1, CHUNK))

        def within(parts: Column) -> Column:
            before = F.concat(F.array(zero), fold(F.transform(parts, lambda p: F.aggregate(p, zero, combine)), zero))
            return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), fold))

        return _let(chunks, within)

    return _let(values, lambda v: F.when(F.size(v) > 0, by_chunks(v)).otherwise(none))


def _matches(text: Column, pattern: str, found: Column) -> Column:
    """Structs (text, end) of all matches of ``pattern``, ``found`` in ``text``."""
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    both = F.zip_with(found, pieces, lambda m, p: F.length(m) + F.length(p))
    return F.zip_with(found, _running(both, lambda a, b: a + b), lambda m, end: F.struct(m.alias("text"), end.alias("end")))


def _base_spans(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long_enough = lambda x: F.length(x) >= least
    span = lambda m: F.struct((m["end"] - F.length(m["text"])).alias("start"), F.lit(order).alias("ord"), m["end"].alias("end"))
    none = F.array().cast(_SPAN)
    if not group:
        return _let(found, lambda f: F.when(F.size(f) > 0, F.transform(_matches(text, pattern, f), span)).otherwise(none))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def kept(f: Column) -> Column:
        marked = F.zip_with(_matches(text, pattern, f), sized, lambda m, s: F.when(long_enough(s), m))
        return F.transform(F.filter(marked, lambda m: m.isNotNull()), span)

    return _let(found, lambda f: F.when(F.size(f) > 0, kept(f)).otherwise(none))


def _weight(count: Column) -> Column:
    """count * log2(count) in fixed point, so that sums have no rounding to carry on."""
    return F.round(count * F.log2(F.greatest(count, F.lit(1)).cast("double")) * _SCALE).cast("long")


def _hottest(text: Column, digits: Column, chars: str, window: int, bits: float, strict: float | None) -> Column:
    """(first, last) offsets of the windows of enough bits, or null if there is none.

    ``total`` is the sum of c * log2(c) over the window's counts, so that the entropy is
    log2(window) - total / window; a step changes two counts. The counts are the characters
    of a string, one for each of the class. A character outside the class empties the window.
    """
    most = lambda b: F.lit(int(((math.log2(window) - b) * window + 1e-9) * _SCALE) if b is not None else -1).cast("long")
    limit = F.when(digits, most(bits)).otherwise(most(strict))
    letters = F.slice(F.split(text, ""), 1, F.length(text))
    codes = F.transform(letters, lambda c: F.position(c, F.lit(chars)))
    none = "0" * len(chars)
    zero, missing = F.lit(0).cast("long"), F.lit(-1)
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(none).alias("counts"), zero.alias("total"), missing.alias("first"), missing.alias("last"))
    count = lambda counts, code: F.ascii(F.substring(counts, code, F.lit(1))) - ord("0")
    put = lambda counts, code, n: F.overlay(counts, F.char(n + ord("0")), code, F.lit(1))

    def fold(codes: Column, limit: Column) -> Column:
        def step(acc: Column, new: Column) -> Column:
            hot = lambda n, total: (n >= window) & (total <= limit)

            def after(counts: Column, total: Column) -> Column:
                n = F.least(acc["n"] + 1, F.lit(window))
                return F.struct(
                    (acc["k"] + 1).alias("k"), n.alias("n"), counts.alias("counts"), total.alias("total"),
                    F.when(hot(n, total) & (acc["first"] < 0), acc["k"] + 1 - window).otherwise(acc["first"]).alias("first"),
                    F.when(hot(n, total), acc["k"] + 1).otherwise(acc["last"]).alias("last"),
                )

            def entered(came: Column) -> Column:
                return _let(F.struct(put(acc["counts"], new, came + 1).alias("counts"), (acc["total"] + _weight(came + 1) - _weight(came)).alias("total")), left)

            def left(now: Column) -> Column:
                old = F.element_at(codes, acc["k"] - window + 1)
                gone = lambda went: after(put(now["counts"], old, went - 1), now["total"] + _weight(went - 1) - _weight(went))
                return F.when(acc["n"] < window, after(now["counts"], now["total"])).otherwise(_let(count(now["counts"], old), gone))

            emptied = F.struct((acc["k"] + 1).alias("k"), F.lit(0).alias("n"), F.lit(none).alias("counts"), zero.alias("total"), acc["first"].alias("first"), acc["last"].alias("last"))
            return F.when(new == 0, emptied).otherwise(_let(count(acc["counts"], new), entered))

        return F.aggregate(codes, start, step, lambda acc: F.when(acc["last"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    return _let(codes, lambda c: _let(limit, lambda m: fold(c, m)))


def _class_pattern(chars: str, window: int) -> str:
    return f"[{chars.replace('-', '')}{'-' * ('-' in chars)}]{{{window}}}"


def _looks(text: Column) -> Column:
    """Whether a candidate has digits enough (true), is a mix of both cases only (false), or is no key (null)."""
    allowed = F.lit(False)
    for pattern in ALLOW_LIST:
        allowed = allowed | text.rlike(pattern)
    digits = (F.regexp_count(text, F.lit("[0-9]")) >= MIN_DIGITS) & text.rlike("[A-Za-z]")
    return F.when(allowed, F.lit(None).cast("boolean")).when(digits, True).when(text.rlike("[a-z]") & text.rlike("[A-Z]"), False)


def _entropy_spans(text: Column) -> Column:
    """Structs (start, ord, end) of the hot stretch of each candidate that has one."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    none = F.array().cast(_SPAN)

    def stretch(m: Column) -> Column:
        def of(s: Column) -> Column:
            by_class = [F.when(s.rlike(_class_pattern(chars, w)), _hottest(s, m["digits"], chars, w, bits, strict)) for _, chars, w, bits, strict in ENTROPY_CLASSES]
            return _let(F.array_compact(F.array(*by_class)), lambda seen: F.struct(F.array_min(F.transform(seen, lambda c: c["first"])).alias("a"), F.array_max(F.transform(seen, lambda c: c["last"])).alias("b")))

        def judged(ends: Column) -> Column:
            part = F.substr(m["text"], ends["a"] + 1, ends["b"] - ends["a"])
            allowed = part.rlike(ALLOWED_PARTS)
            for pattern in ALLOW_LIST:
                allowed = allowed | part.rlike(pattern)
            at = m["end"] - F.length(m["text"])
            return F.when(ends["a"].isNotNull() & ~allowed, F.struct((at + ends["a"]).alias("start"), F.lit(BASE).alias("ord"), (at + ends["b"]).alias("end")))

        return _let(of(m["text"]), judged)

    def each(looks: Column, f: Column) -> Column:
        marked = F.zip_with(_matches(text, CANDIDATE, f), looks, lambda m, d: F.when(d.isNotNull(), F.struct(m["text"].alias("text"), m["end"].alias("end"), d.alias("digits"))))
        return F.filter(F.transform(F.filter(marked, lambda m: m.isNotNull()), stretch), lambda s: s.isNotNull())

    some = lambda f, looks: F.when(F.exists(looks, lambda d: d.isNotNull()), each(looks, f)).otherwise(none)
    return _let(found, lambda f: _let(F.transform(f, _looks), lambda looks: some(f, looks)))


def _outside_base(spans: Column) -> Column:
    """The sorted ``spans`` without entropy spans that lie within a base span."""
    reach = lambda s: _running(F.transform(s, lambda x: F.when(x["ord"] < BASE, x["end"]).otherwise(0)), _larger)
    drop = lambda x, r: F.when((x["ord"] < BASE) | (x["end"] > r), x)
    return _let(spans, lambda s: F.filter(F.zip_with(s, reach(s), drop), lambda x: x.isNotNull()))


def of_kind(kind: str):
    """A predicate on the spans of ``with_spans``."""
    return lambda s: s["ord"] == KINDS.index(kind)


def with_spans(docs: DataFrame, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """``docs`` with an array of structs (start, ord, end) of its secrets, in order.

    ``ord`` is the kind's place in ``KINDS``. Spans of different kinds may overlap; an entropy
    span within a base span is left out. A null or empty text has an empty array. Texts,
    candidates and the number of matches may be of any size; equal rows have equal spans. All
    columns stay; the names of temporary ones start with ``into``.
    """
    tmp = lambda name: f"{into}__{name}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = {tmp(kind): _base_spans(text, n, pattern, group, least) for n, (kind, pattern, group, least) in enumerate(BASE_PATTERNS)}
    found[tmp("entropy")] = _entropy_spans(text)
    out = docs.withColumns(found)
    return out.withColumn(into, _outside_base(F.array_sort(F.concat(*map(F.col, found))))).select(*docs.columns, into)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every maximal run of overlapping ``spans`` (sorted, not empty) replaced by ``mark``.

    The spans become disjoint parts, cut again at the ends of chunks of the text; each chunk,
    marked by a part of its own that sorts first, then folds its own parts.
    """
    part = lambda chunk, a, b, new: F.struct(chunk.alias("chunk"), a.alias("a"), b.alias("b"), new.alias("new"))

    def disjoint(s: Column) -> Column:
        ends = _running(F.transform(s, lambda x: x["end"]), _larger)
        before = _let(ends, lambda e: F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)))
        return F.zip_with(s, before, lambda x, b: F.struct(F.greatest(x["start"], b).alias("a"), x["end"].alias("b"), (x["start"] >= b).alias("new")))

    def by_chunk(x: Column) -> Column:
        first, last = F.floor(x["a"] / CUT_CHUNK).cast("int"), F.floor((x["b"] - 1) / CUT_CHUNK).cast("int")
        return F.transform(F.sequence(first, last), lambda k: part(k, F.greatest(x["a"] - k * CUT_CHUNK, F.lit(0)), F.least(x["b"] - k * CUT_CHUNK, F.lit(CUT_CHUNK)), x["new"] & (k == first)))

    def fold(chunk: Column, parts: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            gap = F.substr(chunk, acc["at"] + 1, p["a"] - acc["at"])
            return F.struct(p["b"].alias("at"), F.concat(acc["out"], gap, F.when(p["new"], mark).otherwise("")).alias("out"))

        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(chunk, acc["at"] + 1, F.lit(CUT_CHUNK))))

    def whole(chunks: Column) -> Column:
        cuts = F.flatten(F.transform(F.filter(disjoint(spans), lambda x: x["a"] < x["b"]), by_chunk))
        heads = F.transform(chunks, lambda c, k: part(k, F.lit(-1), F.lit(-1), F.lit(False)))

        def grouped(parts: Column) -> Column:
            at = F.filter(F.transform(parts, lambda p, k: F.when(p["a"] < 0, k + 1)), lambda k: k.isNotNull())
            ends = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.array(F.size(parts) + 1))
            own = _let(at, lambda a: F.zip_with(a, ends(a), lambda lo, hi: F.slice(parts, lo + 1, hi - lo - 1)))
            return F.array_join(F.zip_with(chunks, own, fold), "")

        return _let(F.array_sort(F.concat(heads, cuts)), grouped)

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT_CHUNK}}}"), F.lit(0)), whole)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; other texts stay as they are.

    Overlapping spans are replaced once. ``length_col``, where there is one, follows the new
    text. Null texts stay null; no row is dropped.
    """
    into = fresh(docs, "secret_spans")
    found, text = with_spans(docs, text_col, into), F.col(text_col)
    out = found.withColumn(text_col, F.when(F.size(into) > 0, _replaced(text.cast("string"), F.col(into), mark)).otherwise(text))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.size(into) > 0, F.length(text).cast(kind)).otherwise(F.col(length_col)))
    return out.select(docs.columns)
