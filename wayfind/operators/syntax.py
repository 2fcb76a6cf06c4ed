"""Syntax of source files as relations: nested nodes, errors, declarations, references.

A source is one row, dealt out by its path. A task reads its sources one chunk after another,
however many there are, and each operator is one such pass without a join or a window:

* **Tokens** come from one regular expression for each language that covers every character, so
  places are running sums of lengths. What a token is becomes a number and flags; all questions
  about neighbours are then NumPy's over a chunk of sources of one language.
* **Nodes** are pairs of brackets, and of block words in Ruby and Lua. The level of a token is a
  running sum of openers less closers, kept from going under zero; the node around a token is
  the last opener of its level, and a closer's own partner is found in the same way. No stack is
  needed, so any depth is safe.
* **Errors** are what does not pair: closers at level zero, openers that nothing closes, pairs
  of two kinds, texts that do not end. Reading goes on after each of them. Nodes deeper than
  ``MAX_DEPTH`` are left out, and said so where they begin.
* **Declarations** are words after a declaring word, or in a declaring place of the node they
  are in. **References** are all other words of the language's kinds.
  A reference is in a call if the nearest node around it that is a call or a block is a call.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.session import share_code

MAX_DEPTH = 2_048

_WORDS = r"[A-Za-z_$][A-Za-z0-9_$]*"
# Possessive repeats run as a loop, however many escapes a text has.
_SLASHES = r"//[^\n]*|/\*[^*]*(?:\*+[^*/][^*]*)*+(?:\*+/)?"
_HASH, _DASHES = r"#[^\n]*", r"--\[\[[\s\S]*?(?:\]\]|\Z)|--[^\n]*"
_DOUBLE, _SINGLE, _BACK = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*+"?', r"'[^'\\\n]*(?:\\.[^'\\\n]*)*+'?", r"`[^`]*`?"
_SCRIPT = rf"{_DOUBLE}|{_SINGLE}|{_BACK}"

#: Comments and strings of each language; what follows them is the same for all.
COMMENTS = {name: _HASH if name in ("python", "ruby") else _DASHES if name == "lua" else _SLASHES for name in ("rust", "javascript", "typescript", "java", "c_sharp", "go", "python", "ruby", "lua")}
LEXERS = {
    "rust": rf"{_DOUBLE}|'(?:[^'\\\n]|\\.)'",
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": rf"{_DOUBLE}|{_SINGLE}",
    "c_sharp": rf"{_DOUBLE}|{_SINGLE}",
    "go": _SCRIPT,
    "python": rf'"""[\s\S]*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE}',
    "ruby": rf"{_DOUBLE}|{_SINGLE}",
    "lua": rf"{_DOUBLE}|{_SINGLE}",
}
#: Code points of sources that one task takes, and that it reads at once: its memory does not grow with the number of files.
PART_CHARS, CHUNK_CHARS = 1_000_000, 300_000
#: The word before a declared name, and its kind.
DECLARING = {
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "const", "static": "static", "mod": "module"},
    "javascript": {"function": "function", "class": "class", "const": "variable", "let": "variable", "var": "variable"},
    "typescript": {"function": "function", "class": "class", "const": "variable", "let": "variable", "var": "variable", "interface": "interface", "type": "type", "enum": "enum"},
    "python": {"def": "function", "class": "class"},
    "ruby": {"def": "method", "class": "class", "module": "module"},
    "java": {"package": "module", "class": "class", "record": "class", "interface": "interface", "enum": "enum"},
    "c_sharp": {"namespace": "module", "class": "class", "record": "class", "struct": "struct", "interface": "interface", "enum": "enum"},
    "go": {"package": "module", "func": "function", "type": "type", "const": "const", "var": "variable"},
    "lua": {"function": "function", "local": "variable"},
}
#: Words that are neither declared nor referred to.
RESERVED = {
    "rust": "fn struct enum trait type const static mod pub use impl let mut for in if else match return self super crate as ref move where while loop str",
    "javascript": "function class const let var new return if else for of in while do switch case import from export default this async await typeof extends static",
    "typescript": "function class const let var new return if else for of in while do switch case import from export default this async await typeof extends static interface type enum public private implements string number",
    "python": "def class return if else elif for in while import from as with try except pass and or not lambda None True False self",
    "ruby": "def class module end do if unless else elsif while until return self nil true false require begin case when then",
    "java": "package class record interface enum public private protected static final void int return new if else for while import this extends implements throws",
    "c_sharp": "namespace class record struct interface enum public private protected internal static void int return new if else for foreach while using this get set var",
    "go": "package func type const var struct interface return if else for range import map chan go defer int string",
    "lua": "function local end do if then else elseif for while repeat until return and or not nil true false in",
}
#: Kinds of references: call, call of a member, member, type (a capital), any other; None: not reported.
REFERENCES = {
    "rust": ("identifier", "field", "field", "type", "identifier"),
    "javascript": ("identifier", "field", "field", "identifier", "identifier"),
    "typescript": ("identifier", "field", "field", "type", "identifier"),
    "python": ("identifier",) * 5,
    "ruby": ("identifier", "identifier", "identifier", "type", "identifier"),
    "java": ("method", "method", None, "type", None),
    "c_sharp": ("method", "method", None, "type", None),
    "go": ("function", "method", "field", "type", None),
    "lua": ("function", "function", "field", "identifier", "identifier"),
}
#: Kinds that own the block after their name.
OWNERS = ("class", "struct", "interface", "enum", "trait", "type", "module")


# What a token is: flags, beside the number of its exact text.
_WORD, _FREE, _TYPED, _CAPITAL, _TYPE_LIKE, _UNENDED = (1 << k for k in range(6))
_EXACT = ["", *"()[]{};.:,=!", ":=", "::", *sorted({w for words in RESERVED.values() for w in words.split()} | {w for words in DECLARING.values() for w in words})]
_NUMBER = {text: k for k, text in enumerate(_EXACT)}
_CLOSERS = ["", ")", "]", "}", "end", "until"]
_KINDS = ["", "method", "field", *sorted({kind for words in DECLARING.values() for kind in words.values()})]
_KIND = {kind: k for k, kind in enumerate(_KINDS)}
_BODIES, _OWNING = ([_KIND[k] for k in names] for names in (("class", "interface", "struct", "enum"), OWNERS))
_UNTYPED, _RUBY_IF = [_NUMBER[w] for w in ("return", "new", "else")], [_NUMBER[w] for w in ("if", "unless", "while", "until")]
# What matters to nesting: an opener that is looked through, of a call, of a block, of braces; a header; the end of a statement; a file's begin; any other word.
_THROUGH, _CALL, _BLOCK, _BRACE, _HEADER, _END, _FILE, _OTHER = range(8)


@cache
def _lexer(language: str) -> tuple[Callable[[str], list[str]], re.Pattern]:
    """What cuts a source into pieces, each a token with the white space and comments before it, and these alone."""
    gap = rf"[ \t\r\n]*+(?:(?:{COMMENTS[language]})[ \t\r\n]*+)*+"
    # A word begins as nothing else does, so words may be sought first.
    return re.compile(rf"{gap}(?:{_WORDS}|[(){{}};,]|{LEXERS[language]}|::|:=|=>|->|[=!<>]=|[0-9]+|[\s\S]|\Z)").findall, re.compile(gap)


def _by_char(flags: dict[str, int]) -> np.ndarray:
    """By a character's code: the flags of all texts that have it."""
    made = np.zeros(256, np.int16)
    for texts, flag in flags.items():
        for text in texts:
            made[ord(text)] |= flag
    return made


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEADS = _by_char({_UPPER: _WORD | _TYPED | _CAPITAL | _TYPE_LIKE, _LOWER: _WORD | _TYPED | _TYPE_LIKE, "_": _WORD | _TYPED | _TYPE_LIKE, "$": _WORD, "]>": _TYPED, "*[": _TYPE_LIKE})
_SPACE = _by_char({" \t\r\n": 1}).astype(bool)
_ONE = _by_char({text: k for text, k in _NUMBER.items() if len(text) == 1})
_LONGEST = 8
#: Of words with a number their first eight characters as one integer, in order; their lengths and numbers.
_NAMED = sorted((int.from_bytes(text.encode()[:_LONGEST].ljust(_LONGEST, b"\0"), "little"), len(text), k) for text, k in _NUMBER.items() if text[:1].isalpha())
_NAMED_KEYS, _NAMED_SIZES, _NAMED_NUMBERS = np.array([x[0] for x in _NAMED], np.uint64), np.array([x[1] for x in _NAMED]), np.array([x[2] for x in _NAMED], np.int16)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(_LONGEST + 1)], np.uint64)
assert len({x[0] for x in _NAMED}) == len(_NAMED)


@cache
def _tables(language: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By a text's number: the bracket that it opens, the one that it closes, the kind that it declares."""
    opens, closes, declares = (np.zeros(len(_EXACT), np.int8) for _ in range(3))
    for k, pair in enumerate(("()", "[]", "{}"), 1):
        opens[_NUMBER[pair[0]]] = closes[_NUMBER[pair[1]]] = k
    words = {"ruby": "def class module begin case do if unless while until", "lua": "function if do repeat"}.get(language, "")
    for word in words.split():
        opens[_NUMBER[word]] = _CLOSERS.index("until" if word == "repeat" else "end")
    if words:
        closes[_NUMBER["end"]] = _CLOSERS.index("end")
    if language == "lua":
        closes[_NUMBER["until"]] = _CLOSERS.index("until")
    for word, kind in DECLARING[language].items():
        declares[_NUMBER[word]] = _KIND[kind]
    return opens, closes, declares


def _by_level(levels: np.ndarray) -> np.ndarray:
    """The order by level, and of one level as before; small numbers are sorted by their digits."""
    return np.argsort(levels.astype(np.int16) if len(levels) == 0 or levels.max() < 32_000 else levels, kind="stable")


class _Chunk:
    """The tokens of some sources of one language, nested.

    Before each source stand three places without a token, and one or two at its end, so that a
    token's neighbours are at its own place plus and less one, two, three.
    """

    def __init__(self, language: str, sources: list[str], words: bool) -> None:
        cut, _ = _lexer(language)
        pieces: list[str] = []
        counts = []
        for source in sources:
            found = cut(source)
            pieces += ("", "", "", *found)
            counts.append(3 + len(found))
        n, ends = len(pieces), np.cumsum(counts)
        self.language, self.joined = language, "".join(sources)
        self.file, begins = np.repeat(np.arange(len(sources)), counts), ends - counts
        self.place = np.arange(n) - np.repeat(begins, counts) - 2
        # One byte for each code point; all that matters here is ASCII.
        if self.joined.isascii():
            chars = np.frombuffer(self.joined.encode(), np.uint8)
        else:
            chars = np.minimum(np.frombuffer(self.joined.encode("utf-32-le"), np.uint32), 255).astype(np.uint8)
        chars = np.concatenate((chars, np.zeros(_LONGEST, np.uint8)))
        self.classify(pieces, chars)
        base = np.cumsum([0, *map(len, sources)])[:-1]
        self.start = self.at - np.repeat(base, counts)
        upto = np.concatenate(([0], np.cumsum(chars == 10)))
        self.line = upto[self.at] - np.repeat(upto[base], counts) + 1
        self.first = np.concatenate(([True], self.line[1:] > self.line[:-1])) | (self.place == 1)
        opens, closes, declares = _tables(language)
        self.opens, self.closes = opens[self.text], closes[self.text]
        if language == "ruby":
            self.opens[np.isin(self.text, _RUBY_IF) & ~self.first] = 0
        self.closes[self.opens != 0] = 0
        self.nest(begins, declares, words)

    def classify(self, pieces: list[str], chars: np.ndarray) -> None:
        """Where each token is, the number of its text, and its flags."""
        stop = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        begin = np.concatenate(([0], stop[:-1]))
        solid = np.where(_SPACE[chars], len(chars), np.arange(len(chars)))
        at = np.minimum(np.minimum.accumulate(solid[::-1])[::-1][begin], stop)
        lead, second = chars[at], chars[at + 1]
        comment = COMMENTS[self.language]
        if comment == _HASH:
            said = lead == ord("#")
        else:
            said = (lead == ord("-")) & (second == ord("-")) if comment == _DASHES else (lead == ord("/")) & ((second == ord("/")) | (second == ord("*")))
        said = np.flatnonzero(said & (at < stop))
        gap = _lexer(self.language)[1]
        at[said] = begin[said] + np.array([gap.match(pieces[k]).end() for k in said.tolist()], np.int64)
        size = stop - at
        lead, second = np.where(size > 0, chars[at], 0), np.where(size > 1, chars[at + 1], 0)
        self.at, self.size = at, size
        self.says, self.text = _LEADS[lead], np.where(size == 1, _ONE[lead], 0)
        self.text[(lead == ord(":")) & (second == ord(":"))] = _NUMBER["::"]
        self.text[(lead == ord(":")) & (second == ord("="))] = _NUMBER[":="]
        word = np.flatnonzero(self.says & _WORD)
        keys = np.lib.stride_tricks.sliding_window_view(chars, _LONGEST)[at[word]].view(np.uint64)[:, 0] & _MASKS[np.minimum(size[word], _LONGEST)]
        found = np.minimum(np.searchsorted(_NAMED_KEYS, keys), len(_NAMED) - 1)
        hit = np.flatnonzero((_NAMED_KEYS[found] == keys) & (_NAMED_SIZES[found] == size[word]))
        word, numbers = word[hit], _NAMED_NUMBERS[found[hit]]
        long = np.flatnonzero(size[word] > _LONGEST)
        differ = [k for k, a, z, number in zip(long.tolist(), at[word[long]].tolist(), stop[word[long]].tolist(), numbers[long].tolist(), strict=True) if self.joined[a:z] != _EXACT[number]]
        numbers[differ] = 0
        self.text[word] = numbers
        reserved = np.isin(np.arange(len(_EXACT)), [_NUMBER[w] for w in RESERVED[self.language].split()])
        self.says[(self.says & _WORD != 0) & ~reserved[self.text]] |= _FREE
        self.says[np.isin(self.text, _UNTYPED)] &= ~_TYPED
        quote = np.flatnonzero((lead == ord('"')) | (lead == ord("`")) | ((lead == ord("'")) & ((size > 1) | (self.language != "rust"))))
        a, z, long = at[quote], stop[quote], size[quote]
        ended = (long > 1) & (chars[z - 1] == lead[quote])
        triple = np.flatnonzero((long > 2) & (chars[a] == 34) & (chars[a + 1] == 34) & (chars[a + 2] == 34))
        z = z[triple]
        ended[triple] = (long[triple] > 5) & (chars[z - 1] == 34) & (chars[z - 2] == 34) & (chars[z - 3] == 34)
        self.says[quote[~ended]] |= _UNENDED

    def nest(self, begins: np.ndarray, declares: np.ndarray, words: bool) -> None:
        """Pairs of brackets and what is around each; with ``words`` also around words.

        The level of a token is a running sum of openers less closers, kept from going under zero.
        Of one level openers and closers take turns, and by level a node's tokens follow its opener.
        """
        n, text = len(self.text), self.text
        empty = lambda: np.full(n, -1, np.int64)
        at = np.flatnonzero((self.opens != 0) | (self.closes != 0))
        opens, file = self.opens[at] != 0, self.file[at]
        total = np.cumsum(np.where(opens, 1, -1))
        total -= np.concatenate(([0], total))[np.searchsorted(at, begins)][file]
        apart = file * (2 * len(at) + 2)  # least sums so far, of each source by itself
        least = np.minimum(np.minimum.accumulate(total - apart) + apart, 0)
        lately = np.concatenate(([0], least[:-1]))[: len(at)]
        lately[1:][file[1:] != file[:-1]] = 0
        depth = total - least  # after a token
        paired = opens | (least == lately)
        pos, of, level = at[paired], opens[paired], (depth - opens)[paired]
        order = _by_level(level)
        pos, of, level = pos[order], of[order], level[order]
        pair = np.flatnonzero(of[:-1] & ~of[1:] & (level[:-1] == level[1:]) & (self.file[pos[:-1]] == self.file[pos[1:]]))
        opener, closer = pos[pair], pos[pair + 1]
        self.around, self.end, self.level = empty(), empty(), empty()
        self.end[opener] = closer
        self.level[at[opens]] = (depth - 1)[opens]

        what = np.full(n, -1, np.int8)
        what[at[opens]] = _BLOCK
        if words:
            before = np.concatenate(([0], text[:-1]))
            self.declares = np.where(self.says & _FREE, declares[before], 0)
            if self.language == "rust":
                after = np.concatenate((text[1:], [0]))
                self.declares[(before == _NUMBER["const"]) & (after != _NUMBER[":"])] = 0
            what[self.says & _FREE != 0] = _OTHER
            what[np.isin(self.declares, _OWNING)] = _HEADER
            what[text == _NUMBER[";"]] = _END
            what[text == _NUMBER["["]] = _THROUGH
            what[text == _NUMBER["{"]] = _BRACE
            call = np.flatnonzero(text == _NUMBER["("])
            what[call] = np.where((self.says[call - 1] & _FREE != 0) & (declares[text[call - 2]] == 0), _CALL, _THROUGH)
        what[begins] = _FILE
        # Openers once more, with the level of what they open.
        near = np.flatnonzero(what >= 0)
        levels, last = np.zeros(n, np.int64), np.searchsorted(at, near) - 1
        levels[near] = np.where((last >= 0) & (file[last] == self.file[near]), depth[last], 0) if len(at) else 0
        levels[at[opens]] = (depth - 1)[opens]
        twice = what[near] < _HEADER
        pos = np.repeat(near, 1 + twice)
        marks = np.zeros(len(pos), bool)
        marks[np.cumsum(1 + twice)[twice] - 1] = True
        order = _by_level(levels[pos] + marks)
        pos, marks = pos[order], marks[order]
        is_ = what[pos]
        begin = marks | (is_ == _FILE)
        here = np.arange(len(pos))
        node = np.maximum.accumulate(np.where(begin, here, 0))
        node = np.where(is_[node] == _FILE, -1, pos[node])
        self.around[pos[~begin]] = node[~begin]
        self.around[closer] = opener
        if words:
            self.partner, self.owner = empty(), empty()
            self.partner[closer] = opener
            said = np.maximum.accumulate(np.where(begin | (is_ == _HEADER) | (is_ == _END) | (is_ == _BRACE), here, 0))
            brace = np.flatnonzero((is_ == _BRACE) & ~marks)
            said = said[brace - 1]
            self.owner[pos[brace]] = np.where((is_[said] == _HEADER), pos[said], -1)
            self.word = np.flatnonzero(self.says & _FREE)
            self.within = self.around[self.word]
            # What is looked through is in a call if what is around it is; the last place stands for no node.
            through = np.flatnonzero(what == _THROUGH)
            up, target = self.around[through], np.arange(n + 1)
            up[up < 0] = n
            target[through] = up
            while not np.array_equal(up, further := target[up]):
                target[through] = up = further
            in_call = np.append(what == _CALL, False)
            in_call[through] = in_call[up]
            self.in_call = in_call[self.within]

    def texts(self, at: np.ndarray) -> pa.Array:
        joined, begin = self.joined, self.at[at]
        return pa.array([joined[a:z] for a, z in zip(begin.tolist(), (begin + self.size[at]).tolist(), strict=True)], pa.string())

    def declared(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word that is not reserved the kind of what it declares, 0 for nothing, and the place of the owner's name, or -1."""
        text, says, w, lang = self.text, self.says, self.word, self.language
        number = _NUMBER.__getitem__
        any_of = lambda where, texts: np.isin(where, list(map(number, texts)))
        before, after, declares, first = text[w - 1], text[w + 1], self.declares[w], self.first[w]
        owner = np.where(self.within >= 0, self.owner[self.within], -1)
        owned = np.where(owner >= 0, self.declares[owner], 0)
        body, typed = np.isin(owned, _BODIES), says[w - 1] & _TYPED != 0
        closing = np.where(after == number("("), self.end[w + 1], -1)
        follows = np.where(closing >= 0, text[closing + 1], 0)
        rules: list[tuple[np.ndarray, np.ndarray | int]] = []
        if lang == "go":
            params = self.partner[w - 1]
            rules.append(((params >= 0) & (text[params] == number("(")) & (text[params - 1] == number("func")), _KIND["method"]))
        dotted = (declares == _KIND["function"]) & any_of(after, ".:") if lang == "lua" else False
        rules.append((declares != 0, np.where(dotted, 0, declares)))
        if lang in ("javascript", "typescript"):
            rules.append((body & (after == number("(")) & any_of(follows, "{:"), _KIND["method"]))
        elif lang in ("java", "c_sharp"):
            rules.append((body & (after == number("(")) & typed & any_of(follows, "{;"), _KIND["method"]))
            rules.append((body & typed & any_of(after, "=;"), _KIND["field"]))
        elif lang == "rust":
            rules.append(((owned == _KIND["struct"]) & (after == number(":")), _KIND["field"]))
        elif lang == "go":
            rules.append(((owned == _KIND["type"]) & first & (says[w + 1] & _TYPE_LIKE != 0), _KIND["field"]))
            rules.append((after == number(":="), _KIND["variable"]))
        elif lang == "lua":
            # A dotted name is declared if its line begins with the word function.
            headed, called = text[w - 3] == number("function"), after == number("(")
            rules.append(((before == number(".")) & called, np.where(headed, _KIND["function"], 0)))
            rules.append(((before == number(":")) & called, np.where(headed, _KIND["method"], 0)))
            rules.append(((before == number(".")) & (after == number("=")), _KIND["field"]))
        if lang in ("python", "ruby", "lua"):  # assignments in brackets declare nothing
            free = (self.within < 0) | ~any_of(text[self.within], "([")
            rules.append((first & (after == number("=")) & free, _KIND["variable"]))
        return np.select([on for on, _ in rules], [kind for _, kind in rules], 0), owner


def _take(names: list[str | None], at: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(at))


#: Columns of nodes.
NODE = {"node": "long", "parent": "long", "depth": "long", "opens": "string", "closed": "string", "end_n": "long", "follows": "string", "line": "long", "start": "long"}


def _nodes(c: _Chunk, columns: tuple[str, ...]) -> dict[str, pa.Array]:
    at = np.flatnonzero(c.opens)
    end, around, n = c.end[at], c.around[at], c.place
    closed = end >= 0

    def follows() -> pa.Array:
        after = c.texts(np.where(closed, end + 1, 0))
        return pc.if_else(pc.equal(after, ""), None, after)

    made = {
        "node": lambda: n[at], "parent": lambda: pa.array(n[around], mask=around < 0), "depth": lambda: c.level[at] + 1, "opens": lambda: _take(_CLOSERS, c.opens[at]),
        "closed": lambda: _take([None, *_CLOSERS[1:]], np.where(closed, c.closes[end], 0)), "end_n": lambda: pa.array(n[end], mask=~closed), "follows": follows,
        "line": lambda: c.line[at], "start": lambda: c.start[at],
    }
    return {"at": at} | {k: made[k]() for k in columns}


def _errors(c: _Chunk, max_depth: int) -> dict[str, pa.Array]:
    opens = c.opens != 0
    closed = opens & (c.end >= 0)
    named = lambda at: [_EXACT[k] for k in c.text[at].tolist()]
    stray, open_, deep, unended = (np.flatnonzero(on) for on in ((c.closes != 0) & (c.around < 0), opens & ~closed, opens & (c.level == max_depth), c.says & _UNENDED))
    other = np.flatnonzero(closed)
    other = other[c.opens[other] != c.closes[c.end[other]]]
    said = [f"unexpected {x}" for x in named(stray)] + [f"unclosed {x}" for x in named(open_)]
    said += [f"closed otherwise: {x} {y}" for x, y in zip(named(other), named(c.end[other]), strict=True)]
    said += [f"deeper than {max_depth}"] * len(deep) + ["unended text"] * len(unended)
    at = np.concatenate((stray, open_, other, deep, unended))
    return {"at": at, "line": c.line[at], "start": c.start[at], "detail": pa.array(said, pa.string())}


def _spans(c: _Chunk, at: np.ndarray) -> dict[str, object]:
    return {"at": at, "language": pa.repeat(pa.scalar(c.language), len(at)), "n": c.place[at], "start": c.start[at], "line": c.line[at], "name": c.texts(at)}


def _declarations(c: _Chunk) -> dict[str, pa.Array]:
    kind, owner = c.declared()
    on = kind > 0
    owner = owner[on]
    names = c.texts(np.maximum(owner, 0))
    return _spans(c, c.word[on]) | {"kind": _take(_KINDS, kind[on]), "owner": pc.if_else(pa.array(owner >= 0), names, None)}


def _references(c: _Chunk, declared: bool) -> dict[str, pa.Array]:
    """``declared``: words that are declared too."""
    text, w, lang = c.text, c.word, c.language
    number = _NUMBER.__getitem__
    member = np.isin(text[w - 1], [number("."), number("::"), number(":")] if lang == "lua" else [number("."), number("::")])
    called = (text[w + 1] == number("(")) | ((text[w + 1] == number("!")) & (lang == "rust"))
    capital = (c.says[w] & _CAPITAL != 0) & ~member & (~called | (text[w - 1] == number("new"))) & (lang in ("rust", "typescript", "ruby", "java", "c_sharp", "go"))
    form = np.select([capital, called & member, called, member], [3, 1, 0, 2], 4)
    kinds = REFERENCES[lang]
    is_kind = lambda kind: np.array([k == kind for k in kinds])[form]
    evidence = np.select([is_kind("type"), is_kind("method") | called | c.in_call, is_kind("field")], [0, 1, 2], 3)
    on = ~is_kind(None) if declared else ~is_kind(None) & (c.declared()[0] == 0)
    return _spans(c, w[on]) | {"kind": _take(list(kinds), form[on]), "evidence": _take(["type_reference", "call", "member_reference", "bare_reference"], evidence[on])}


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[str], list[str]]]:
    """(language, paths, sources) of a few sources at once."""
    for batch in batches:
        held: dict[str, tuple[list[str], list[str]]] = {}
        sizes: Counter[str] = Counter()
        for path, language, source in zip(*(batch.column(k) for k in range(3)), strict=True):
            lang, text = language.as_py(), source.as_py()
            paths, sources = held.setdefault(lang, ([], []))
            paths.append(path.as_py())
            sources.append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= CHUNK_CHARS:
                yield lang, *held.pop(lang)
                sizes[lang] = 0
        yield from ((lang, paths, sources) for lang, (paths, sources) in held.items())


def _read(files: DataFrame, made: Callable[[_Chunk], dict[str, pa.Array]], words: bool, columns: str) -> DataFrame:
    """Rows that ``made`` makes of each chunk of ``files`` (path, language, source), in one pass where they are."""
    share_code(files.sparkSession)
    schema = f"path string, {columns}"

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, paths, sources in _chunks(batches):
            chunk = _Chunk(language, sources, words)
            found = made(chunk)
            rows = [_take(paths, chunk.file[found.pop("at")]), *(x if isinstance(x, pa.Array) else pa.array(x) for x in found.values())]
            yield pa.RecordBatch.from_arrays(rows, ["path", *found])

    return files.mapInArrow(each, schema)


def parts(files: DataFrame, column: str = "source") -> int:
    """In how many parts sources are dealt out: as many as shuffles have, or more for long ones."""
    size = files.agg(F.sum(F.length(column).cast("long"))).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_CHARS))


def readable(files: DataFrame) -> DataFrame:
    """(path, language, source) of files whose language has a lexer here; a null source is empty."""
    return files.where(F.col("language").isin(list(LEXERS))).select("path", "language", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))


def analysed(files: DataFrame) -> DataFrame:
    """``readable`` files dealt out by path; all else here begins with either. Paths must be unique."""
    return readable(files).repartition(parts(files), "path")


def nodes(files: DataFrame, columns: tuple[str, ...] = tuple(NODE)) -> DataFrame:
    """(path, node, parent, depth, opens, closed, end_n, follows, line, start): a node for each opener, ``follows`` the token after its end.

    ``node`` and ``end_n`` count tokens from 1 without white space and comments; ``start`` is in code points
    from 0, ``line`` from 1. ``end_n`` is null for a node that nothing closes, ``parent`` for one in no other.
    Only ``columns`` are made, and path.
    """
    return _read(files, lambda c: _nodes(c, columns), False, ", ".join(f"{k} {NODE[k]}" for k in columns))


def errors(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, line, start, detail) of everything that does not fit, in any number; a path without tokens has none."""
    return _read(files, lambda c: _errors(c, max_depth), False, "line long, start long, detail string")


def declarations(files: DataFrame) -> DataFrame:
    """(path, language, n, start, line, name, kind, owner) of every declaration."""
    return _read(files, _declarations, True, "language string, n long, start long, line long, name string, kind string, owner string")


def references(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(path, language, n, start, line, name, kind, evidence) of the words that no declaration spans.

    ``declared`` are other declarations than those of ``files``, left out by a join; None: those are, without one.
    """
    every = declared is not None
    found = _read(files, lambda c: _references(c, every), True, "language string, n long, start long, line long, name string, kind string, evidence string")
    return found if declared is None else found.join(declared.select("path", "start"), ["path", "start"], "left_anti").select(found.columns)
