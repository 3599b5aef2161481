"""Text helpers built from Spark's own string functions."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, functions as F

from parapet import fixed_values as fv

# White space as a regex class body.  Single characters and one guarded range
# keep the test of an ordinary character to a table lookup.
WHITESPACE = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CHARACTERS = string.ascii_letters + string.digits + r"_\p{L}\p{N}"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# long s, dotless i and the dot that lower-casing splits off a dotted capital I
SPECIAL_LETTERS = "\u017f\u0131\u0307"
_FOLDED = {0x17f: "s", 0x131: "i", 0x307: None}


def has_special_letters(lowered: Column) -> Column:
    return any_of([F.contains(lowered, F.lit(c)) for c in SPECIAL_LETTERS])


def fold_special(lowered: str) -> str:
    """What ``fold`` makes of a lower-cased text with special letters."""
    return lowered.translate(_FOLDED)


def fold(content: Column) -> Column:
    """Lower-cased text in which every letter that matches an ASCII letter
    case-insensitively has become that letter."""
    lowered = F.lower(content)
    return F.when(
        has_special_letters(lowered), F.translate(lowered, SPECIAL_LETTERS, "si")
    ).otherwise(lowered)


def trimmed(content: Column) -> Column:
    """Strip white space (not only blanks) on both ends."""
    return F.btrim(content, F.lit(WHITESPACE_CHARACTERS))


def words(content: Column) -> Column:
    """White-space separated, lower-cased tokens."""
    return F.array_remove(F.split(F.lower(content), f"[{WHITESPACE}]+"), "")


def terms(content: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(
        F.lower(content), F.lit(f"[{WORD_CHARACTERS}]{{2,}}"), F.lit(0)
    )


def truncate_tokens(content: Column, limit: int = fv.MAX_TOKENS) -> Column:
    """The first ``limit`` white-space tokens, joined by single blanks."""
    tokens = F.array_remove(F.split(content, f"[{WHITESPACE}]+"), "")
    return F.array_join(F.slice(tokens, 1, limit), " ")


def preview(content: Column, length: int) -> Column:
    """The first ``length`` characters, with an ellipsis if text was cut."""
    head = F.substring(content, 1, length)
    return F.when(F.length(content) > length, F.concat(head, F.lit("…"))).otherwise(head)


def contains_keyword(content: Column, keywords: list[str] | None = None) -> Column:
    """True if any keyword occurs in the lower-cased text."""
    lowered = F.lower(content)
    return any_of([F.contains(lowered, F.lit(k)) for k in keywords or fv.KEYWORDS])


def keyword_share(content: Column, full_at: int = 3, keywords: list[str] | None = None) -> Column:
    """Distinct keywords found, as a share of ``full_at``, at most 1.

    A deterministic stand-in for a classifier probability.
    """
    lowered = F.lower(content)
    found = [F.contains(lowered, F.lit(k)).cast("int") for k in keywords or fv.KEYWORDS]
    total = reduce(lambda a, b: a + b, found)
    return F.least(F.lit(1.0), total / F.lit(float(full_at)))
