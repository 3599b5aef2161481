"""The text classifier: n-gram TF-IDF with a logistic regression."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window, functions as F

from parapet import fixed_values as fv
from parapet.config import DEFAULT, ScreeningConfig
from parapet.functions.text import WORD_CHARACTERS, terms
from parapet.operators.lineage import cut_lineage, shared_dir
from parapet.operators.metrics import metrics_by_group
from parapet.operators.ordered import match_nulls


def word_ngrams(df: DataFrame, content: str = "content", output: str = "ngrams") -> DataFrame:
    """Add all 1-, 2- and 3-grams of the text's terms, repeats included."""
    frame = df.withColumn("_one", terms(F.col(content)))
    for size, column in [(2, "_two"), (3, "_three")]:
        frame = NGram(n=size, inputCol="_one", outputCol=column).transform(frame)
    return frame.withColumn(output, F.concat("_one", "_two", "_three")).drop(
        "_one", "_two", "_three"
    )


def top_terms(grams: DataFrame, limit: int = fv.MAX_FEATURES) -> DataFrame:
    """The terms with the highest corpus frequency, ties by term.

    Frequencies are summed up before the shuffle, whatever document they are from.
    """
    return _most_frequent(grams.groupBy("term").agg(F.count("*").alias("corpus_frequency")), limit)


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    return counts.orderBy(F.desc("corpus_frequency"), "term").limit(limit)


def top_ngrams(df: DataFrame, tokens: str = "_one", limit: int = fv.MAX_FEATURES) -> list[str]:
    """The most frequent 1-, 2- and 3-grams of the arrays of terms in ``tokens``, ties by term.

    A 3-gram is no more frequent than the two terms it begins with, and comes after them in a
    tie.  So only those that begin with one of the most frequent 2-grams can be among the
    first ``limit``, and no others are counted.
    """
    def grams(size: int) -> DataFrame:
        named = NGram(n=size, inputCol=tokens, outputCol="_grams").transform(df.select(tokens))
        # a plain explode makes the optimizer check the array first, which computes it twice
        exploded = named.select(F.explode_outer("_grams").alias("term"))
        return exploded.where(F.col("term").isNotNull())

    short = cut_lineage(top_terms(grams(1).unionByName(grams(2)), limit))
    beginnings = F.broadcast(short.select(F.col("term").alias("_begins")))  # at most ``limit`` rows
    begins = F.substring_index("term", " ", 2) == F.col("_begins")
    counted = grams(3).join(beginnings, begins, "left_semi").groupBy("term").agg(
        F.count("*").alias("corpus_frequency"))
    return [r["term"] for r in _most_frequent(short.unionByName(counted), limit).collect()]


def _parts(vectors: DataFrame, column: str, name: str) -> DataFrame:
    """Add what a sparse vector holds, as an array of (place, value)."""
    import numpy as np
    import pyarrow as pa

    def list_parts(given: pa.Array) -> pa.Array:
        values = given.field("values")
        offsets = pa.array(np.concatenate([[0], np.cumsum(values.value_lengths())]), pa.int32())
        pairs = pa.StructArray.from_arrays(
            [given.field("indices").flatten(), values.flatten()], names=["place", "value"])
        return pa.ListArray.from_arrays(offsets, pairs)

    list_parts.__annotations__ = {"given": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(list_parts, "array<struct<place: int, value: double>>")
    return vectors.withColumn(name, udf(column))


def _merged(counted: DataFrame, id_column: str) -> DataFrame:
    """(id, parts) with one row per id: rows that share an id are added up."""
    repeated = cut_lineage(counted.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1").select(id_column))
    if repeated.isEmpty():
        return counted
    parts = match_nulls(counted, repeated, [id_column], "left_semi").select(id_column, F.explode("_parts").alias("part"))
    summed = parts.groupBy(id_column, "part.place").agg(F.sum("part.value").alias("value"))
    listed = summed.groupBy(id_column).agg(F.collect_list(F.struct("place", "value")).alias("_parts"))
    return match_nulls(counted, repeated, [id_column], "left_anti").unionByName(listed)


def tfidf(
    df: DataFrame,
    id_column: str,
    content: str = "content",
    limit: int = fv.MAX_FEATURES,
) -> DataFrame:
    """(id, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), with
    every document scaled to length 1.

    Terms are counted within each row, against a vocabulary of at most ``limit``: neither
    texts nor a document's terms are shuffled or stored.
    """
    tokens = df.select(id_column, F.coalesce(terms(F.col(content)), F.array().cast("array<string>")).alias("_one"))
    vocabulary = top_ngrams(tokens, "_one", limit)
    if not vocabulary:
        return df.sparkSession.createDataFrame([], df.select(id_column).schema.add("term", "string").add("weight", "double"))
    grams = word_ngrams(df.select(id_column, content), content).withColumn(
        "ngrams", F.coalesce("ngrams", F.array().cast("array<string>")))
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="ngrams", outputCol="_counts").transform(grams)
    merged = _merged(_parts(counts, "_counts", "_parts").select(id_column, "_parts"), id_column)
    documents = df.agg(F.count("*")).scalar()
    listed = merged.select(id_column, F.explode("_parts").alias("part"))
    places = df.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place int, term string")
    found = listed.groupBy("part.place").agg(F.count("*").alias("df")).join(F.broadcast(places), "place")
    idf = cut_lineage(found.select(
        "place", "term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    known = np.zeros(len(vocabulary))
    for row in idf.collect():  # at most ``limit`` rows
        known[row["place"]] = row["idf"]
    weights = _unit_weights(known)("_parts")
    weighted = merged.select(id_column, F.explode(weights).alias("part")).select(id_column, "part.*")
    return weighted.join(F.broadcast(idf), "place").select(id_column, "term", F.col("value").alias("weight"))


def _unit_weights(idf: np.ndarray):
    """A function on (place, count) arrays: damped, weighted by ``idf``, scaled to length 1."""
    import pyarrow as pa

    def weigh(given: pa.Array) -> pa.Array:
        lengths = given.value_lengths().to_numpy(zero_copy_only=False)
        flat = given.flatten()
        places = flat.field("place")
        raw = (1.0 + np.log(flat.field("value").to_numpy(zero_copy_only=False))) * idf[places.to_numpy(zero_copy_only=False)]
        rows = np.repeat(np.arange(len(lengths)), lengths)
        scaled = raw / np.sqrt(np.bincount(rows, raw * raw, minlength=len(lengths)))[rows]
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        pairs = pa.StructArray.from_arrays([places, pa.array(scaled, pa.float64())], names=["place", "value"])
        return pa.ListArray.from_arrays(offsets, pairs)

    weigh.__annotations__ = {"given": pa.Array, "return": pa.Array}
    return F.arrow_udf(weigh, "array<struct<place: int, value: double>>")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: its count and n / (classes * count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(
        label, "n",
        (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))
        .alias("weight"),
    )


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias("class_weight"))
    # one row per class; a shuffle by class would send all texts of one to one task
    return df.join(F.broadcast(weights), label)


class SublinearCounts(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Replaces every count c of a sparse vector by 1 + ln c."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        import numpy as np
        import pyarrow as pa

        def damp(vectors: pa.Array) -> pa.Array:
            values = vectors.field("values")
            damped = 1.0 + np.log(values.flatten().to_numpy(zero_copy_only=False))
            offsets = pa.array(np.concatenate([[0], np.cumsum(values.value_lengths())]), pa.int32())
            return pa.StructArray.from_arrays(
                [vectors.field("type"), vectors.field("size"), vectors.field("indices"),
                 pa.ListArray.from_arrays(offsets, pa.array(damped, pa.float64()))],
                names=["type", "size", "indices", "values"],
            )

        damp.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
        udf = F.arrow_udf(damp, VectorUDT())
        return dataset.withColumn(self.getOutputCol(), udf(self.getInputCol()))


def _term_stages() -> list:
    return [
        RegexTokenizer(
            inputCol="content", outputCol="_one", gaps=False, toLowercase=True,
            pattern=f"[{WORD_CHARACTERS}]{{2,}}", minTokenLength=1,
        ),
        NGram(n=2, inputCol="_one", outputCol="_two"),
        NGram(n=3, inputCol="_one", outputCol="_three"),
        SQLTransformer(
            statement="SELECT *, concat(_one, _two, _three) AS _ngrams FROM __THIS__"
        ),
    ]


_SCRATCH = [
    "_one", "_two", "_three", "_ngrams", "_counts", "_damped", "_scaled", "_features",
    "_raw", "_probability", "_prediction",
]


@dataclass
class Features:
    """stages: what turns a text into its features.  rows: label, class_weight and
    features of the training rows, stored.  count: of these rows."""

    stages: list
    rows: DataFrame
    count: int


def fit_features(train: DataFrame, limit: int = fv.MAX_FEATURES) -> Features:
    """The TF-IDF features of content and label; at most ``limit`` terms, ties by term."""
    weighted = with_class_weight(train.select("content", "label"))
    terms_of = PipelineModel(stages=_term_stages())
    vocabulary = top_ngrams(terms_of.stages[0].transform(weighted), "_one", limit)
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_ngrams", outputCol="_counts")
    counting = PipelineModel(
        stages=[*terms_of.stages, counts, SublinearCounts(inputCol="_counts", outputCol="_damped")]
    )
    damped = cut_lineage(
        counting.transform(weighted).select("label", "class_weight", "_counts", "_damped")
    )
    # document frequencies; smoothed as ln((1 + n) / (1 + df)) + 1
    idf = IDF(inputCol="_counts", outputCol="_unused").fit(damped).idf.toArray() + 1.0
    scale = ElementwiseProduct(
        scalingVec=DenseVector(idf), inputCol="_damped", outputCol="_scaled"
    )
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol="_features")
    rows = unit.transform(scale.transform(damped))
    return Features([*counting.stages, scale, unit], rows, damped.count())


def fit_regression(
    features: Features, inverse_penalty: float = 1.0, max_iterations: int = 1000,
    tolerance: float = 1e-4,
) -> PipelineModel:
    """A balanced L2 logistic regression on given features.

    The average loss that Spark minimises makes the penalty 1 / (C * sum of
    weights); balanced weights add up to the row count.
    """
    model = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="class_weight",
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
        regParam=1.0 / (inverse_penalty * features.count), elasticNetParam=0.0,
        standardization=False, maxIter=max_iterations, tol=tolerance,
    ).fit(features.rows)
    # Its summary of the training holds the session, which goes to the tasks with the model,
    # and cannot once a query of the session has been observed.  A stored model has none.
    path = f"{shared_dir(features.rows.sparkSession).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return PipelineModel(stages=[*features.stages, LogisticRegressionModel.load(path)])


def fit_logistic(
    train: DataFrame,
    limit: int = fv.MAX_FEATURES,
    inverse_penalty: float = 1.0,
    max_iterations: int = 1000,
    tolerance: float = 1e-4,
) -> PipelineModel:
    """Fit TF-IDF and a balanced L2 logistic regression on content and label.

    Scoring with the result is map-only.
    """
    return fit_regression(fit_features(train, limit), inverse_penalty, max_iterations, tolerance)


def score_classifier(
    df: DataFrame, model: PipelineModel, config: ScreeningConfig = DEFAULT
) -> DataFrame:
    """Add ``classifier_score`` (probability of class 1), ``classifier_label``
    at the threshold and ``classifier_argmax``."""
    scored = model.transform(df)
    return (
        scored.withColumn("classifier_score", vector_to_array("_probability")[1])
        .withColumns({
            "classifier_label":
                (F.col("classifier_score") >= config.thresholds.classifier).cast("int"),
            "classifier_argmax": F.col("_prediction").cast("int"),
        })
        .drop(*_SCRATCH)
    )


def select_model(
    train: DataFrame,
    validation: DataFrame,
    penalties: list[float] = (0.01, 0.1, 1.0, 10.0, 100.0),
    patience: int = 2,
    limit: int = fv.MAX_FEATURES,
) -> tuple[PipelineModel, list[dict]]:
    """Keep the model with the best validation F1; stop after ``patience``
    candidates without gain.  Returns it with accuracy, F1, P and R per candidate."""
    best, best_f1, idle, report = None, -1.0, 0, []
    features = fit_features(train, limit)  # the same for all candidates
    for penalty in penalties:
        model = fit_regression(features, penalty)
        scored = score_classifier(validation, model).select(
            F.lit("validation").alias("system"), "label",
            F.col("classifier_argmax").alias("prediction"),
        )
        row = metrics_by_group(scored, ["system"]).first()
        report.append({
            "inverse_penalty": penalty, "accuracy": row["accuracy"], "f1": row["f1"],
            "precision": row["precision"], "recall": row["recall"],
        })
        if row["f1"] > best_f1:
            best, best_f1, idle = model, row["f1"], 0
        else:
            idle += 1
            if idle >= patience:
                break
    return best, report


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
