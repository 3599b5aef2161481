"""Intent drift: how far message vectors point away from the declared intent."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet import fixed_values as fv
from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.text import terms
from parapet.functions.vectors import drift

VECTOR_SIZE = 256


def intent_from_vectors(df: DataFrame, vector: str = "embedding") -> list[float]:
    """Mean vector of the given rows: one aggregation, one vector to the driver."""
    mean = df.select(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("mean")
    ).first()["mean"]
    return [float(v) for v in mean]


def centroid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The mean vector as one row."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.select(vector_to_array(mean).alias("intent"))


def embed_text(
    df: DataFrame, content: str = "content", output: str = "embedding", size: int = VECTOR_SIZE
) -> DataFrame:
    """Hashed term counts as a vector.

    Stands in where no pretrained vectors are at hand; a table that brings an
    ``array<float>`` column does not need it.
    """
    tokens = df.withColumn("_terms", terms(F.col(content)))
    hashed = HashingTF(inputCol="_terms", outputCol="_vector", numFeatures=size).transform(tokens)
    return hashed.withColumn(output, vector_to_array("_vector")).drop("_terms", "_vector")


def intent_from_text(
    spark: SparkSession, text: str = fv.DEFAULT_INTENT_TEXT, size: int = VECTOR_SIZE
) -> list[float]:
    """The vector of one task description, computed once and used as a constant."""
    row = embed_text(spark.range(1).select(F.lit(text).alias("content")), size=size).first()
    return [float(v) for v in row["embedding"]]


def score_drift(
    df: DataFrame,
    intent: list[float],
    vector: str = "embedding",
    config: ScreeningConfig = DEFAULT,
) -> DataFrame:
    """Add ``drift_score`` and ``drift_label``."""
    scored = df.withColumn("drift_score", drift(F.col(vector), intent))
    return scored.withColumn(
        "drift_label", (F.col("drift_score") >= config.thresholds.drift).cast("int")
    )
