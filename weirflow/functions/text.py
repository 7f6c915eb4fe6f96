"""Columns over text: lines, sizes, token estimates, entropy, masks. Null stays null; empty text has one empty line, no tokens and entropy 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: scripts in which a character is worth more of a token.
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7a3]"
#: The same class for RE2.
CJK_RE2 = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7a3}]"

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    r"""A pattern with ASCII word edges (\b as RE2 means it) for Java, in which \b knows all letters."""
    return re.sub(r"(?<!\\)\\b", lambda _: _EDGE, pattern)


def lines(text: Column) -> Column:
    """The lines of a text; a line feed at its end makes a last empty line."""
    return F.split(text, "\n", -1)


def line_rows(df, key: str, text: str):
    """One row per line: the key, n (from 1), line. Rows without text give none."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("i", "line")).select(key, (F.col("i") + 1).alias("n"), "line")


def token_estimate(text: Column) -> Column:
    """Tokens by character class: 1.5 CJK characters or 4 others a token, each rounded up."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (F.ceil(cjk / 1.5) + F.ceil((F.char_length(text) - cjk) / 4)).cast("long")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character."""
    n = F.char_length(value).cast("double")
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda c: (F.char_length(value) - F.char_length(F.replace(value, c, F.lit("")))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def mask(value: Column) -> Column:
    """A preview that is safe to show: up to four characters, stars, and the length of long values."""
    n = F.char_length(value)
    keep = F.least(F.lit(4), F.greatest(F.lit(0), n - 2))
    stars = F.repeat(F.lit("*"), F.least(F.lit(16), F.greatest(F.lit(4), n - keep)))
    return F.concat(value.substr(F.lit(1), keep), stars, F.when(n > 40, F.concat(F.lit(" (len "), n.cast("string"), F.lit(")"))).otherwise(""))


def normalised_line(line: Column) -> Column:
    """A line with hex numbers, durations, numbers and blanks in one form, so that repeats of a message are equal."""
    x = F.regexp_replace(line, r"(?i)0x[0-9a-f]+", "0xHEX")
    x = F.regexp_replace(x, java(r"(?i)\b[0-9]+(\.[0-9]+)?(ms|s|m)\b"), "NUMt")
    x = F.regexp_replace(x, java(r"\b[0-9][0-9_,.]*\b"), "NUM")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n\f]+", " "))


def half_up(value: Column) -> Column:
    """Rounding half towards plus infinity."""
    return F.floor(value + 0.5)


def runs(numbers: Column) -> Column:
    """Ascending line numbers as runs: array of (first, last)."""
    start = F.filter(numbers, lambda x: ~F.array_contains(numbers, x - 1))
    stop = F.filter(numbers, lambda x: ~F.array_contains(numbers, x + 1))
    return F.arrays_zip(start.alias("first"), stop.alias("last"))
