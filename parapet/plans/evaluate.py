"""Evaluation jobs: ablation and comparison with simpler systems."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from parapet import fixed_values as fv
from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.picks import pick_number
from parapet.functions.text import contains_keyword
from parapet.operators.metrics import metrics_by_type, system_metrics
from parapet.operators.text_model import fit_logistic, score_classifier
from parapet.plans.detect import detect
from parapet.plans.layers import Layers

LAYER_COLUMNS = {
    "rules": ("rule_label", "rule_score"),
    "drift": ("drift_label", "drift_score"),
    "classifier": ("classifier_label", "classifier_score"),
    "full": ("full_label", "confidence"),
}


def with_layer_labels(detections: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Add the verdict each layer gives on its own."""
    t = config.thresholds
    return detections.withColumns({
        "drift_label": (F.col("drift_score") >= t.drift).cast("int"),
        "classifier_label": (F.col("classifier_score") >= t.classifier).cast("int"),
        "full_label": F.col("is_injected").cast("int"),
    })


def ablation(detections: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    """Metrics of every layer alone and of the full system."""
    return system_metrics(
        with_layer_labels(detections, config), LAYER_COLUMNS, config=config
    )


def evaluation_by_type(detections: DataFrame, config: ScreeningConfig = DEFAULT) -> DataFrame:
    labelled = with_layer_labels(detections, config)
    return metrics_by_type(labelled, "full_label", "confidence", config=config)


BASELINE_SYSTEMS = {
    fv.SYSTEM_NONE: ("none_label", None),
    fv.SYSTEM_KEYWORDS: ("keyword_label", "keyword_score"),
    fv.SYSTEM_TEXT_MODEL: ("text_label", "text_score"),
    fv.SYSTEM_RULES: ("rule_label", "rule_score"),
    fv.SYSTEM_CLASSIFIER: ("classifier_label", "classifier_score"),
    fv.SYSTEM_FULL: ("full_label", "confidence"),
}


def held_out_scores(messages: DataFrame, config: ScreeningConfig = DEFAULT, tolerance: float = 1e-9) -> DataFrame:
    """Add text_label and text_score, by a regression that was fitted on other messages.

    A hash of message_id deals the messages into two halves; each is scored by the model
    of the other, so that all are tested and none by a model that has seen it.  A half
    that lacks a class teaches nothing: the other one is then judged benign, with score 0.
    A missing text is an empty one.
    """
    half = F.coalesce(pick_number(F.col("message_id"), "half", 2), F.lit(0))
    dealt = messages.withColumns({
        "_half": half, "_given": F.col("content"), "content": F.coalesce("content", F.lit(""))})
    classes = {r["_half"]: r["n"] for r in dealt.groupBy("_half").agg(F.count_distinct("label").alias("n")).collect()}
    parts = []
    for own in (0, 1):
        part = dealt.where(F.col("_half") == own)
        if classes.get(1 - own, 0) == 2:
            model = fit_logistic(dealt.where(F.col("_half") != own), tolerance=tolerance)
            part = score_classifier(part, model, config).withColumns({
                "text_label": F.col("classifier_argmax"), "text_score": F.col("classifier_score")})
        else:
            part = part.withColumns({"text_label": F.lit(0), "text_score": F.lit(0.0)})
        parts.append(part.withColumn("content", F.col("_given")).select(*messages.columns, "text_label", "text_score"))
    return parts[0].unionByName(parts[1])


def baseline_predictions(
    messages: DataFrame, layers: Layers | None = None, text_model: PipelineModel | None = None,
    as_of: bool = True, held_out: bool = False,
) -> DataFrame:
    """Predictions and scores of all six systems for every message, in one job.

    held_out: the TF-IDF system is fitted on the messages, half by half.
    """
    layers = layers or Layers()
    keyword = contains_keyword(F.col("content")).cast("int")
    marked = messages.withColumns({
        "none_label": F.lit(0), "keyword_label": keyword,
    })
    kept = [c for c in marked.columns if c not in ("content", "embedding")]
    if text_model is not None:
        scored = score_classifier(marked, text_model, layers.config).select(
            *marked.columns, F.col("classifier_argmax").alias("text_label"),
            F.col("classifier_score").alias("text_score"),
        )
        marked, kept = scored, [*kept, "text_label", "text_score"]
    elif held_out:
        marked, kept = held_out_scores(marked, layers.config), [*kept, "text_label", "text_score"]
    detected = detect(marked, layers, as_of, keep=kept, digits=None)
    return with_layer_labels(detected, layers.config).withColumn(
        "keyword_score", F.col("keyword_label").cast("double")
    )


def baseline_comparison(
    test: DataFrame, train: DataFrame | None = None, layers: Layers | None = None,
    text_model: PipelineModel | None = None, as_of: bool = True, held_out: bool = False,
) -> DataFrame:
    """One metric row per system on the same test messages.

    Without training rows or a model the TF-IDF system is fitted on the other half of the
    test messages if ``held_out``, as of ``held_out_scores``, and else left out.
    """
    layers = layers or Layers()
    if text_model is None and train is not None:
        text_model = fit_logistic(train)
    systems = {
        name: columns for name, columns in BASELINE_SYSTEMS.items()
        if text_model is not None or held_out or columns[0] != "text_label"
    }
    predictions = baseline_predictions(test, layers, text_model, as_of, held_out)
    return system_metrics(predictions, systems, config=layers.config)
