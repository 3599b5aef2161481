"""Seeded picks: every random choice is a hash of the row's id.

A row gets the same value whichever task computes it, so a lost executor or
another partition count changes nothing, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def shuffle_key(row_id: Column, seed: str) -> Column:
    """32 hex digits by which rows are put into a seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")).cast("binary"))


def pick_number(row_id: Column, seed: str, choices: int) -> Column:
    """A number from 0 to choices - 1."""
    digits = F.substring(shuffle_key(row_id, seed), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") % F.lit(choices)


def pick_between(row_id: Column, seed: str, low: int, high: int) -> Column:
    return pick_number(row_id, seed, high - low + 1) + F.lit(low)


def pick_one(row_id: Column, seed: str, values: list[str]) -> Column:
    choice = pick_number(row_id, seed, len(values)) + F.lit(1)
    return F.element_at(F.lit(list(values)), choice.cast("int"))
