"""Flooding checks: back-to-back repetition and low lexical diversity."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType

from parapet import fixed_values as fv
from parapet.functions.text import words


_PRIME = 2**31 - 1
_SLICE = 1 << 20  # places compared at once, at most
_FIRST_SLICE = 1 << 11


class _Prefixes:
    """Hashes of all parts of a text: sums of characters times powers of a base.

    Equal parts have equal hashes.  The base is random; what is found by hashes is
    compared character by character before it counts, so results don't depend on it.
    """

    base = random.randrange(2**20, _PRIME - 1)
    powers = np.ones(1, np.int64)

    def __init__(self, text: np.ndarray):
        if len(self.powers) <= len(text):
            type(self).powers = self._powers(len(text) + 1)
        values = text.astype(np.int64) * self.powers[:len(text)] % _PRIME
        self.sums = np.zeros(len(text) + 1, np.int64)
        np.cumsum(values, out=self.sums[1:])
        self.sums %= _PRIME

    @classmethod
    def _powers(cls, count: int) -> np.ndarray:
        powers = cls.powers
        while len(powers) < count:  # the second half is the first times a power
            step = pow(cls.base, len(powers), _PRIME)
            powers = np.concatenate([powers, powers * step % _PRIME])
        return powers

    def same(self, at: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether the part of so many characters looks like the one ``shift`` further on."""
        own = (self.sums[at + size] - self.sums[at]) % _PRIME * self.powers[shift] % _PRIME
        return own == (self.sums[at + shift + size] - self.sums[at + shift]) % _PRIME

    def extent(self, at: np.ndarray, limit: np.ndarray, shift: np.ndarray, back: bool) -> np.ndarray:
        """How many characters from ``at`` on (or before it) come back ``shift`` further on."""
        good, bad = np.zeros_like(at), limit + 1
        while (bad - good > 1).any():
            middle = (good + bad) // 2
            same = self.same(at - middle if back else at, middle, shift)
            good, bad = np.where(same, middle, good), np.where(same, bad, middle)
        return good


def _stretch(letters: np.ndarray, low: int, high: int, shift: int, whole: int) -> bool:
    """Whether from low to high ``whole * shift`` characters in a row come back ``shift`` further on."""
    low, high = max(low, 0), min(high, len(letters) - shift)
    differ = np.flatnonzero(letters[low:high] != letters[low + shift:high + shift])
    return np.diff(np.r_[-1, differ, high - low]).max() > whole * shift


def repeats(text: str, min_unit: int = fv.REPEAT_MIN_UNIT, copies: int = fv.REPEAT_MIN_COPIES) -> bool:
    """Whether some unit of at least ``min_unit`` characters stands ``copies`` times in a row.

    With a unit of p characters this is a stretch of (copies - 1) * p places whose
    character comes back p places on.  Such a stretch holds a whole block of a grid
    with blocks of half that size, so for every p only n / (half * p) blocks are looked
    at, n log n / half in all, by a few characters and then by hashes, made once a block
    needs them.  A block that comes back is followed to both sides by bisection.
    Stretches that fall short are of bounded total length (a text's runs have bounded
    total exponent), so there is no text that takes much longer.
    """
    n = len(text)
    if n < min_unit * copies:
        return False
    if text.isascii():
        letters = np.frombuffer(text.encode(), np.uint8)
    else:
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed = None
    half, whole = (copies - 1) // 2, copies - 1
    probes = sorted({half * min_unit * k // 7 for k in (0, 1, 3, 4, 6)})  # inside the smallest block
    periods = np.arange(min_unit, n // copies + 1)
    blocks = (n - periods) // (half * periods)  # that fit, with what they are compared with
    stop = np.cumsum(blocks)
    first, size = 0, _FIRST_SLICE  # most repetitions are of short units
    while first < len(periods):
        last = max(int(np.searchsorted(stop, (stop[first - 1] if first else 0) + size, "right")), first + 1)
        size = min(8 * size, _SLICE)
        own = blocks[first:last]
        p_all = np.repeat(periods[first:last], own)
        at_all = (np.arange(len(p_all)) - np.repeat(np.cumsum(own) - own, own)) * half * p_all
        for step in probes:  # a block that comes back has each of these characters twice
            alike = letters[at_all + step] == letters[at_all + p_all + step]
            at_all, p_all = at_all[alike], p_all[alike]
            if not len(p_all):
                break
        first = last
        if not len(p_all):
            continue
        if _stretch(letters, at_all[0] - whole * p_all[0], at_all[0] + 2 * whole * p_all[0], p_all[0], whole):
            return True  # most often so, with no hash made
        hashed = hashed or _Prefixes(letters)
        found = np.flatnonzero(hashed.same(at_all, half * p_all, p_all))
        for some in (found[:1], found[1:]):  # in a long repetition any block will do
            if not len(some):
                continue
            at, p = at_all[some], p_all[some]
            need = (whole - half) * p
            right = hashed.extent(at + half * p, np.minimum(need, n - p - at - half * p), p, False)
            left = hashed.extent(at, np.minimum(need, at), p, True)
            for i in np.flatnonzero(left + right >= need).tolist():
                if _stretch(letters, at[i] - left[i], at[i] + half * p[i] + right[i], p[i], whole):
                    return True
    return False


@F.arrow_udf(BooleanType())
def _repeats(texts: pa.Array) -> pa.Array:
    """Text by text: a worker holds a batch as it came, and one text of it as a string."""
    return pa.array((t.is_valid and repeats(t.as_py()) for t in texts), pa.bool_())


def periodic_repeat(content: Column) -> Column:
    """True if the case-folded text holds a long back-to-back repetition.

    Texts too short to hold one are not sent to Python.
    """
    shortest = fv.REPEAT_MIN_UNIT * fv.REPEAT_MIN_COPIES
    return _repeats(F.when(F.length(content) >= shortest, F.lower(content)))


def flood_words(content: Column) -> Column:
    """Tokens of a text long enough to be judged; null for shorter ones."""
    return F.when(F.length(content) >= fv.FLOOD_MIN_CHARS, words(content))


def low_diversity(tokens: Column) -> Column:
    """True if few of the tokens are distinct."""
    share = F.size(F.array_distinct(tokens)) / F.size(tokens)
    return F.coalesce(
        F.when(F.size(tokens) > 0, share < fv.FLOOD_MAX_UNIQUE_RATIO), F.lit(False)
    )
