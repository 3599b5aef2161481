"""From four layer scores to one decision with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parapet import fixed_values as fv
from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.numbers import round_to


def base_suspicion(rule: Column, classifier: Column) -> Column:
    return rule * F.lit(0.5) + classifier * F.lit(0.5)


def fused_score(config: ScreeningConfig = DEFAULT) -> Column:
    """Weighted sum of the layers; drift and risk go in rounded."""
    w = config.weights
    return (
        F.lit(w.rule) * F.col("rule_score")
        + F.lit(w.classifier) * F.col("classifier_score")
        + F.lit(w.drift) * F.col("drift_score")
        + F.lit(w.cascade) * F.col("cascade_score")
    )


def predicted_type(rule_type: Column, injected: Column) -> Column:
    """The rule type wherever a rule matched, even if the message passes."""
    return (
        F.when(rule_type != fv.BENIGN, rule_type)
        .when(injected, F.lit(fv.UNKNOWN_INJECTION))
        .otherwise(F.lit(fv.BENIGN))
    )


def two_digits(value: Column) -> Column:
    return F.format_string("%.2f", round_to(value, 2))


def explanation(config: ScreeningConfig = DEFAULT) -> Column:
    """One part per layer over its threshold."""
    t = config.thresholds
    matched, scored, closed = (F.lit(part) for part in fv.REASON_RULES)
    drifted, above = (F.lit(part) for part in fv.REASON_DRIFT)
    parts = F.concat_ws(
        fv.REASON_SEPARATOR,
        F.when(
            F.col("rule_score") >= t.rule,
            F.concat(matched, F.col("rule_type"), scored, two_digits(F.col("rule_score")), closed),
        ),
        F.when(
            F.col("classifier_score") >= t.classifier,
            F.concat(F.lit(fv.REASON_CLASSIFIER), two_digits(F.col("classifier_score"))),
        ),
        F.when(
            F.col("drift_score") >= t.drift,
            F.concat(drifted, two_digits(F.col("drift_score")), above),
        ),
        F.when(
            F.col("cascade_score") >= t.cascade,
            F.concat(F.lit(fv.REASON_CASCADE), two_digits(F.col("cascade_score"))),
        ),
    )
    return F.when(parts == "", F.lit(fv.NO_SIGNAL)).otherwise(parts)


def fuse(df: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Decision, confidence, predicted type and explanation of every message.

    Needs rule_score, rule_type, classifier_score, drift_score and
    cascade_risk.  The decision uses the unrounded sum, confidence is rounded.
    """
    rounded = df.withColumn("cascade_score", round_to(F.col("cascade_risk"), 4))
    fused = rounded.withColumn("_fused", fused_score(config))
    decided = fused.withColumns({
        "is_injected": F.col("_fused") >= config.thresholds.fused,
        "confidence": round_to(F.col("_fused"), 4),
        "explanation": explanation(config),
    })
    return decided.withColumns({
        "predicted_type": predicted_type(F.col("rule_type"), F.col("is_injected")),
        "quarantined": F.col("is_injected"),
    }).drop("_fused")
