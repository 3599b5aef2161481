"""Licence statements in texts, by Dice coefficient over word bigrams.

Lines and paragraphs are the units that are compared with the templates.  A unit
of n bigrams can only reach a Dice coefficient t with templates of t / (2 - t) * n
to (2 - t) / t * n bigrams; the others are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8
#: Statements to look for; a caller's own catalogue goes in their place.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(own: Column) -> Column:
    """Distinct pairs of neighbouring words; none of fewer than two words."""
    first = F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(first, F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def _pairs(text: str) -> list[str]:
    import re

    own = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:])))


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, unit (its text), licence, dice: every unit and template that reach the threshold.

    A unit is a line, or a paragraph of several lines.  Equal units of a text are
    one.  A null, empty or wordless text has no match.  Repeated rows give
    repeated matches.  Other columns play no part.
    """
    known = [(name, _pairs(text)) for name, text in templates]
    known = [(name, own) for name, own in known if own]
    ratio = (2 - threshold) / threshold
    least = min((len(own) for _, own in known), default=1) / ratio
    most = max((len(own) for _, own in known), default=0) * ratio
    catalogue = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, own)).alias("own"))
                          for name, own in known])
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.array_distinct(F.array_union(F.split(text, "\n"), F.split(text, r"\n\s*\n")))
    rows = docs.select(F.col(id_col), F.explode(units).alias("unit"))
    # a unit of n bigrams has at least 2 n characters more or less; repeats make it longer, never shorter
    rows = rows.where(F.length("unit") >= 2 * least + 1)
    rows = rows.withColumn("_own", bigrams(words(F.col("unit"))))
    rows = rows.where(F.size("_own").between(least, most))
    both = lambda t: F.size(F.array_intersect(F.col("_own"), t["own"]))
    fits = F.filter(catalogue, lambda t: (F.size(t["own"]) <= F.size("_own") * ratio)
                    & (F.size("_own") <= F.size(t["own"]) * ratio))
    dice = F.transform(fits, lambda t: F.struct(
        t["licence"].alias("licence"), (2 * both(t) / (F.size("_own") + F.size(t["own"]))).alias("dice")))
    found = rows.select(id_col, "unit", F.explode(F.filter(dice, lambda d: d["dice"] >= threshold)).alias("_d"))
    return found.select(id_col, "unit", "_d.licence", "_d.dice")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, licence, dice (the best), units: what each text states."""
    return matches(docs, templates, threshold, id_col, text_col).groupBy(id_col, "licence").agg(
        F.max("dice").alias("dice"), F.countDistinct("unit").alias("units"))
