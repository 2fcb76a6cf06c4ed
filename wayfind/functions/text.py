"""Column functions on texts, times and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a comment line a generated-file header.
COMMENT_MARKERS = ("//", "#", "/*", "*", "<!--", "--")
GENERATED_PHRASES = ("@generated", "generated file", "this file is generated", "this file was generated", "automatically generated")
MINIFIED_EXTENSIONS = ("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx")
MARKDOWN_SPECIAL = "\\`*_{}[]()#+-.!|<>"

DAY = 86_400


def in_window(seconds: Column, now: int, days: int) -> Column:
    """At or after ``now`` less so many days; later times count too."""
    return seconds >= F.lit(now - days * DAY)


def is_merge(parents: Column) -> Column:
    return F.size(parents) >= 2


def keyword_list(keywords: tuple[str, ...]) -> list[str]:
    """Trimmed, lower-cased, sorted and distinct; empty ones are dropped."""
    return sorted({k.strip().lower() for k in keywords if k.strip()})


def matched_keywords(message: Column, keywords: tuple[str, ...], substring: bool = False) -> Column:
    """The keywords that a message holds, sorted; as words, or anywhere if ``substring``.

    A word is bounded by what is neither alphabetic, numeric nor an underscore. The pattern
    looks back only from where the keyword stands.
    """
    low = F.lower(message)
    edge = r"[\p{IsAlphabetic}\p{N}_]"
    hits = [
        F.when(low.contains(k) if substring else low.rlike(f"{re.escape(k)}(?<!{edge}{re.escape(k)})(?!{edge})"), F.lit(k)) for k in keyword_list(keywords)
    ]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def month(seconds: Column) -> Column:
    """YYYY-MM in UTC of epoch seconds, before 1970 too."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def capture_date(seconds: Column) -> Column:
    return F.date_format(F.date_trunc("DAY", F.timestamp_seconds(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / 4))


def sanitize(text: Column) -> Column:
    """Control characters become U+FFFD."""
    return F.regexp_replace(text, r"\p{Cc}", "�")


def escape_inline_code(text: Column) -> Column:
    return F.translate(sanitize(text), "`", "'")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(sanitize(text), "([" + re.escape(MARKDOWN_SPECIAL) + "])", r"\\$1")


def inline_code_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("`"), escape_inline_code(x), F.lit("`"))), ", ")


def collapse(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bounded(text: Column, n: int) -> Column:
    """At most ``n`` code points, the last an ellipsis where some are cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def digest(parts: Column) -> Column:
    """SHA-256 in hexadecimal of an array of strings joined by NUL."""
    return F.sha2(F.concat_ws("\0", parts), 256)


def generated_marker(content: Column) -> Column:
    """Whether one of the first 16 lines is a comment that says the file is generated."""
    lines = F.slice(F.split(content, "\n"), 1, 16)
    marker = "|".join(re.escape(m) for m in COMMENT_MARKERS)

    def says(line: Column) -> Column:
        low = F.lower(line)
        plain = F.lit(False)
        for phrase in GENERATED_PHRASES:
            plain = plain | low.contains(phrase)
        return line.rlike(rf"^\s*({marker})") & (plain | (low.contains("code generated") & low.contains("do not edit")))

    return F.exists(lines, says)


def minified(ext: Column, content: Column) -> Column:
    """A script of 1 to 64 KiB in at most three long lines with next to no white space."""
    size, lines = F.octet_length(content), F.size(F.split(F.regexp_replace(content, "\n$", ""), "\n"))
    space = F.length(content) - F.length(F.regexp_replace(content, r"\s", ""))
    return ext.isin(*MINIFIED_EXTENSIONS) & size.between(1_024, 65_536) & (lines <= 3) & (F.floor(size / lines) >= 512) & (space * 100 <= size * 2)


def looks_generated(path: Column, content: Column) -> Column:
    """The path, or the first 512 characters, say generated."""
    return F.lower(path).contains("generated") | F.lower(F.substring(content, 1, 512)).contains("generated")


def binary(content: Column) -> Column:
    """A NUL byte, or no valid UTF-8."""
    return F.contains(content, F.lit(b"\0")) | ~F.is_valid_utf8(content.cast("string"))


def scaled_score(score: Column) -> Column:
    """A score of at least 0 in millionths, half away from zero."""
    return F.round(F.greatest(score, F.lit(0.0)) * 1e6).cast("long")


def churn_rate(commits: Column, size: Column) -> Column:
    """Thousandths of a commit for each KiB, rounded down; null for an empty file."""
    return F.when(size > 0, F.floor(commits * 1_024_000 / size).cast("long"))


def share_percent(part: Column, total: Column) -> Column:
    """Whole percent, rounded down."""
    return F.floor(part * 100 / F.greatest(total, F.lit(1))).cast("int")


def object_format(oid: Column) -> Column:
    return F.when(F.length(oid) == 40, "sha1").when(F.length(oid) == 64, "sha256")
