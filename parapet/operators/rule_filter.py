"""The rule filter: all rule checks of a message and the score made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parapet import fixed_values as fv
from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.decoding import decode_scan
from parapet.functions.rules import DEFAULT_RULES, MANY_RULES, Rule, hits_by_type
from parapet.functions.scan import look
from parapet.functions.text import fold, has_special_letters


def count_column(attack_type: str) -> str:
    return f"n_{attack_type}"


COUNT_COLUMNS = [count_column(t) for t in fv.ATTACK_TYPES]
RULE_COLUMNS = [
    "rule_hits", "decode_hit", "low_diversity_hit", "periodic_hit",
    *COUNT_COLUMNS, "rule_total", "rule_score", "rule_type", "rule_label",
]


def find_hits(
    df: DataFrame,
    content: str = "content",
    rules: list[Rule] | None = None,
    periodic: bool = True,
) -> DataFrame:
    """Add what the rules find: names of matching rules, the three structural
    checks and the hit count of every attack type.

    Map-only.  A worker looks at every text once (``parapet.functions.scan``).  The text
    is folded once; the next projection reads that column.
    """
    text = F.col(content)
    rules = DEFAULT_RULES if rules is None else rules
    prepared = df.withColumns({
        "_folded": fold(text), "_special": has_special_letters(F.lower(text)),
        "_look": look(F.lower(text), rules if len(rules) <= MANY_RULES else [], periodic),
    })
    by_type = hits_by_type(rules, text, F.col("_folded"), F.col("_special"), F.col("_look.candidates"))
    long_enough = F.coalesce(F.length(text) >= fv.FLOOD_MIN_CHARS, F.lit(False))
    found = prepared.select(
        *df.columns,
        *[names.alias(f"_hits_{kind}") for kind, names in by_type.items()],
        decode_scan(text, F.col("_look.token")).alias("decode_hit"),
        (long_enough & F.col("_look.few_words")).alias("low_diversity_hit"),
        F.col("_look.repeats").alias("periodic_hit"),
    )
    weights = {
        "encoded_payload": F.when(F.col("decode_hit"), fv.DECODE_WEIGHT).otherwise(0),
        "context_flooding": F.when(F.col("low_diversity_hit"), fv.FLOOD_WEIGHT).otherwise(0)
        + F.col("periodic_hit").cast("int"),
    }
    counts = []
    for kind in fv.ATTACK_TYPES:
        parts = [F.size(f"_hits_{kind}")] if kind in by_type else [F.lit(0)]
        if kind in weights:
            parts.append(weights[kind])
        counts.append(reduce(lambda a, b: a + b, parts).cast("int").alias(count_column(kind)))
    all_hits = [F.col(f"_hits_{kind}") for kind in by_type]
    names = F.concat(*all_hits) if all_hits else F.array().cast("array<string>")
    return found.select(
        *df.columns, names.alias("rule_hits"),
        "decode_hit", "low_diversity_hit", "periodic_hit", *counts,
    )


def rule_total() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in COUNT_COLUMNS])


def rule_score(total: Column) -> Column:
    return F.least(F.lit(1.0), total * F.lit(fv.HIT_SCORE))


def rule_type() -> Column:
    """The type with most hits; the one declared first wins a tie."""
    most = F.greatest(*[F.col(c) for c in COUNT_COLUMNS])
    kind = F.lit(fv.BENIGN)
    for name in reversed(fv.ATTACK_TYPES):
        kind = F.when((most > 0) & (F.col(count_column(name)) == most), name).otherwise(kind)
    return kind


def score_rules(
    df: DataFrame,
    content: str = "content",
    rules: list[Rule] | None = None,
    config: ScreeningConfig = DEFAULT,
) -> DataFrame:
    """Add hits, total, score, most likely type and label of the rule filter."""
    found = find_hits(df, content, rules, config.periodic_rule)
    totalled = found.withColumns({"rule_total": rule_total(), "rule_type": rule_type()})
    scored = totalled.withColumn("rule_score", rule_score(F.col("rule_total")))
    return scored.withColumn(
        "rule_label", (F.col("rule_score") >= config.thresholds.rule).cast("int")
    ).select(*df.columns, *RULE_COLUMNS)
