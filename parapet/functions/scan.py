"""One look at every text in a worker: what it rules out, and what words alone tell.

Guards of rules and the search for base64 tokens run here as linear-time searches
over whole batches; the rules themselves stay column expressions, which run
only on the texts that may match.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from parapet import fixed_values as fv
from parapet.functions.repetition import repeats
from parapet.functions.rules import Rule
from parapet.functions.text import SPECIAL_LETTERS, fold_special

_RESULT = "candidates array<int>, token boolean, few_words boolean, repeats boolean"
# lower-casing keeps the characters of a token, or makes others look like them
_TOKEN = "[a-z0-9+/=]{20}"
_PARTS = 7  # that groups of words are divided into
_SHORT = 4  # characters


def _holds_any(texts: pa.Array, words: list[str]) -> np.ndarray:
    found = pc.match_substring_regex(texts, "|".join(re.escape(w) for w in words))
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


def _holding(texts: pa.Array, rows: np.ndarray, groups: list[tuple]) -> dict[tuple, np.ndarray]:
    """Of each group of words, the rows whose text (in ``texts``) holds one.

    Groups are searched all at once first, then in parts, in the texts that hold any:
    one search for many words costs little more than one for a single word.
    """
    found = np.flatnonzero(_holds_any(texts, sorted({w for words in groups for w in words})))
    rows = rows[found]
    if len(groups) == 1:
        return {groups[0]: rows}
    if not len(rows):
        return dict.fromkeys(groups, rows)
    held, size = {}, -(-len(groups) // _PARTS)
    texts = texts.take(pa.array(found))
    for first in range(0, len(groups), size):
        held |= _holding(texts, rows, groups[first:first + size])
    return held


def guarded(texts: pa.Array, guards: list[list[list[str]]]) -> pa.Array:
    """Of every folded text, the numbers of the guards it satisfies: of each group, a word.

    Every group is searched only in the texts that hold the groups before it.
    """
    ordered = [sorted(groups, key=lambda words: -min(len(w) for w in words)) for groups in guards]
    firsts = list(dict.fromkeys(tuple(groups[0]) for groups in ordered))
    # short words are in many texts, and would lead all searches there
    short = [words for words in firsts if min(len(w) for w in words) < _SHORT]
    everywhere = np.arange(len(texts))
    first = {words: own for some in ([x for x in firsts if x not in short], *([x] for x in short)) if some
             for words, own in _holding(texts, everywhere, some).items()}
    rows, numbers = [], []
    for number, rare_first in enumerate(ordered):
        left = first[tuple(rare_first[0])]
        for words in rare_first[1:]:
            if len(left):
                left = left[_holds_any(texts.take(pa.array(left)), words)]
        rows.append(left)
        numbers.append(np.full(len(left), number, np.int32))
    row = np.concatenate([np.zeros(0, np.int64), *rows])
    number = np.concatenate([np.zeros(0, np.int32), *numbers])[np.argsort(row, kind="stable")]
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(number))


def few_distinct_words(text: str) -> bool:
    """True if few of the words of a lower-cased text are distinct."""
    words = text.split()
    return bool(words) and len(set(words)) / len(words) < fv.FLOOD_MAX_UNIQUE_RATIO


def look_at(texts: pa.Array, guards: list[list[list[str]]], periodic: bool) -> pa.Array:
    """What ``look`` gives, of lower-cased texts."""
    folded = texts
    if guards:
        special = _holds_any(texts, list(SPECIAL_LETTERS))
        if special.any():
            folded = pa.array([fold_special(t.as_py()) if s else t.as_py() for t, s in zip(texts, special)], texts.type)
    few, again = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
    for at, own in enumerate(texts):  # a text at a time
        if own.is_valid:
            text = own.as_py()
            few[at] = few_distinct_words(text)
            again[at] = periodic and repeats(text)
    token = pc.fill_null(pc.match_substring_regex(texts, _TOKEN), False)
    return pa.StructArray.from_arrays(
        [guarded(folded, guards), token, pa.array(few), pa.array(again)],
        ["candidates", "token", "few_words", "repeats"])


def look(lowered: Column, rules: list[Rule], periodic: bool) -> Column:
    """candidates: which of the rules with a guard, by place among these, may match; token:
    whether there may be a base64 token; few_words: whether few words are distinct; repeats:
    whether there is a long back-to-back repetition (False without ``periodic``).

    Rules that bring no guard aren't looked at.
    """
    guards = [r.guard_groups() for r in rules if r.guard]

    @F.arrow_udf(_RESULT)
    def looked(texts: pa.Array) -> pa.Array:
        return look_at(texts, guards, periodic)

    return looked(lowered)
