"""Layers as exchangeable parts: each adds its score columns to a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType

from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.rules import DEFAULT_RULES, Rule
from parapet.functions.text import keyword_share
from parapet.operators.drift import embed_text, intent_from_text, score_drift
from parapet.operators.rule_filter import score_rules
from parapet.operators.text_model import score_classifier

Layer = Callable[[DataFrame, ScreeningConfig], DataFrame]


def rule_layer(rules: list[Rule] | None = None) -> Layer:
    """rule_score and rule_type from the catalogue or a rule set of your own."""
    return lambda df, config: score_rules(df, rules=rules or DEFAULT_RULES, config=config)


def classifier_from_column(probability: Column) -> Layer:
    """Any expression on the message columns: a built-in function, a Pandas UDF
    or a batch-inference UDF of a model of your own."""
    return lambda df, config: df.withColumn("classifier_score", probability.cast("double"))


def from_batches(
    load: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str = "content",
    result: DataType = DoubleType(), batch_size: int = 256,
) -> Column:
    """A model applied to batches of texts: ``load`` is called once a worker, and gives a
    function from an array of texts to an array of results.

    A missing text is an empty one.  For a classifier a result is a probability; for an
    encoder, an array of floats of one length.
    """
    return predict_batch_udf(load, return_type=result, batch_size=batch_size)(F.coalesce(F.col(column), F.lit("")))


def classifier_from_batches(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 256) -> Layer:
    """A classifier of your own, loaded once a worker and asked batch by batch."""
    return classifier_from_column(from_batches(load, batch_size=batch_size))


def drift_from_batches(
    load: Callable[[], Callable[[np.ndarray], np.ndarray]], intent: list[float], batch_size: int = 256
) -> Layer:
    """An encoder of your own; its vectors are compared with the intent's."""

    def apply(df: DataFrame, config: ScreeningConfig) -> DataFrame:
        vectors = from_batches(load, result=ArrayType(FloatType()), batch_size=batch_size)
        return score_drift(df.withColumn("_embedding", vectors), intent, "_embedding", config).drop("_embedding")

    return apply


def classifier_from_model(model: PipelineModel) -> Layer:
    return lambda df, config: score_classifier(df, model, config)


def keyword_classifier() -> Layer:
    return classifier_from_column(keyword_share(F.col("content")))


def drift_from_column(vector: str, intent: list[float]) -> Layer:
    """Vectors the table brings along."""
    return lambda df, config: score_drift(df, intent, vector, config)


def drift_from_table(vectors: DataFrame, key: str, vector: str, intent: list[float]) -> Layer:
    """Vectors of another table, joined by ``key``; a message without one is unrelated.

    With ``drift_reads_text=False`` the join moves scores and previews, not texts.
    """

    def apply(df: DataFrame, config: ScreeningConfig) -> DataFrame:
        return score_drift(df.join(vectors.select(key, vector), key, "left"), intent, vector, config).drop(vector)

    return apply


def drift_from_text(text: str | None = None) -> Layer:
    """Hashed term vectors of the message and of the task description."""

    def apply(df: DataFrame, config: ScreeningConfig) -> DataFrame:
        intent = intent_from_text(df.sparkSession, text) if text else intent_from_text(df.sparkSession)
        return score_drift(
            embed_text(df, output="_embedding"), intent, "_embedding", config
        ).drop("_embedding")

    return apply


def constant_drift(value: float = 0.5) -> Layer:
    """Unrelated texts have cosine 0, hence drift 0.5."""
    return lambda df, config: df.withColumns(
        {"drift_score": F.lit(value), "drift_label": F.lit(int(value >= config.thresholds.drift))}
    )


@dataclass(frozen=True)
class Layers:
    """The layers of one screening run."""

    rules: Layer = field(default_factory=rule_layer)
    classifier: Layer = field(default_factory=keyword_classifier)
    drift: Layer = field(default_factory=drift_from_text)
    drift_reads_text: bool = True
    config: ScreeningConfig = DEFAULT
