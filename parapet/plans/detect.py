"""The screening job: a message table in, one decision per message out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parapet import fixed_values as fv
from parapet.functions.numbers import round_to
from parapet.functions.text import preview
from parapet.operators.fusion import base_suspicion, fuse
from parapet.operators.senders import cascade_context
from parapet.plans.layers import Layers

DETECTION_COLUMNS = [
    "rule_score", "rule_type", "rule_label", "classifier_score", "drift_score",
    "base_suspicion", "suspicion_history", "cascade_potential", "cascade_score", "high_risk",
    "is_injected", "confidence", "predicted_type", "explanation", "quarantined",
]

ROUNDED = {
    "rule_score", "classifier_score", "drift_score", "base_suspicion", "suspicion_history",
    "cascade_potential",
}


def score_texts(
    messages: DataFrame, layers: Layers | None = None, keep: list[str] | None = None
) -> DataFrame:
    """All scores that depend on one message only.  Map-only, but for vectors of another table.

    The text ends here: what goes on into the sender shuffle is its preview.  A drift layer
    that reads no text gets the rows without it.
    """
    layers = layers or Layers()
    config = layers.config
    scored = layers.rules(messages, config)
    scored = layers.classifier(scored, config)
    kept = keep if keep is not None else [
        c for c in messages.columns if c not in ("content", "embedding")
    ]
    scored = scored.withColumn("content_preview", preview(F.col("content"), fv.AUDIT_PREVIEW_CHARS))
    if not layers.drift_reads_text and "content" not in kept:
        scored = scored.drop("content")
    scored = layers.drift(scored, config)
    return scored.select(
        *kept,
        "content_preview",
        "rule_score", "rule_type", "rule_label", "classifier_score", "drift_score",
        base_suspicion(F.col("rule_score"), F.col("classifier_score")).alias("base_suspicion"),
    )


def detect(
    messages: DataFrame, layers: Layers | None = None, as_of: bool = True,
    keep: list[str] | None = None, estimated: bool = False, digits: int | None = 4,
) -> DataFrame:
    """Scores, decision, predicted type and explanation of every message.

    ``messages`` has message_id, seq (unique), content, from_agent and
    to_agent.  ``estimated`` (without ``as_of``) takes reach from sketches.  Graph
    and bucket bounds are computed from the narrow columns when this is called;
    scoring itself stays lazy.  Decisions are made on unrounded scores; the scores of
    the row are rounded to ``digits``, or not at all (None), as evaluation wants them.
    """
    layers = layers or Layers()
    scored = score_texts(messages, layers, keep)
    placed = cascade_context(scored, config=layers.config, as_of=as_of, estimated=estimated)
    fused = fuse(placed, layers.config)
    passed_on = [c for c in scored.columns if c not in DETECTION_COLUMNS]
    row = [
        round_to(F.col(c), digits).alias(c) if digits is not None and c in ROUNDED else F.col(c)
        for c in DETECTION_COLUMNS
    ]
    return fused.select(*[F.col(c) for c in passed_on], *row)
