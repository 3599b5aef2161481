import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Observation, functions as F

from parapet import fixed_values as fv
from parapet.config import Scale, ScreeningConfig
from parapet.functions.numbers import round_to
from parapet.operators import drift, fusion, metrics, routing, text_model
from parapet.operators.corpus import build_corpus
from parapet.plans.detect import detect
from parapet.functions.picks import pick_number
from parapet.plans.evaluate import baseline_comparison, held_out_scores
from parapet.plans.layers import Layers, classifier_from_model, constant_drift, drift_from_text

SMALL = ScreeningConfig(scale=Scale(rows_per_bucket=20))


def scores(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_metrics_where_nothing_is_predicted(spark):
    row = metrics.classification_metrics(scores(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"], row["fpr"]) == (0, 0, 0, 0.5, 0)
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 0, 1, 1)


def test_auc_edges(spark):
    assert metrics.auc_roc(scores(spark, [(1, 0, 0.5), (0, 0, 0.5), (1, 1, 0.5)])).first()["auc"] == 0.5
    assert metrics.auc_roc(scores(spark, [(1, 0, 0.5), (1, 0, 0.7)])).first()["auc"] == 0.0
    assert metrics.auc_roc(scores(spark, [(1, 0, 0.9), (0, 0, 0.7)])).first()["auc"] == 1.0


@pytest.mark.parametrize("config", [ScreeningConfig(), SMALL])
def test_auc_agrees_with_evaluator(spark, config):
    rng = random.Random(11)
    rows = [(rng.randint(0, 1), 0, round(rng.random(), 2)) for _ in range(500)]
    df = scores(spark, rows)
    reference = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert metrics.auc_roc(df, config=config).first()["auc"] == pytest.approx(reference, abs=1e-12)
    points = metrics.roc_points(df, config=config).orderBy("fpr", "tpr").collect()
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(reference, abs=1e-9)
    assert (points[0]["fpr"], points[-1]["tpr"]) == (0.0, 1.0)


@pytest.mark.parametrize("config", [ScreeningConfig(), SMALL])
def test_distribution_agrees_with_numpy(spark, config):
    rng = random.Random(2)
    values = [round(rng.expovariate(0.1), 2) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = metrics.score_distribution(df, "v", config=config).first()
    assert row["mean"] == pytest.approx(np.mean(values), abs=0.0051)
    assert row["median"] == pytest.approx(np.median(values), abs=0.0051)
    assert row["p95"] == pytest.approx(np.percentile(values, 95), abs=0.0051)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(81)], "v double")
    bins = {r["bin"]: r["n"] for r in metrics.histogram(df, "v").collect()}
    assert bins[40] == 3 and sum(bins.values()) == 81 and min(bins) == 1
    one = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(r["n"] for r in metrics.histogram(one, "v").collect()) == 2


def test_groups_with_one_row_are_left_out(spark):
    df = spark.createDataFrame(
        [("x", 1, 1, 0.9), ("x", 1, 0, 0.1), ("y", 1, 1, 0.9)],
        "attack_type string, label int, prediction int, score double",
    )
    rows = metrics.metrics_by_type(df).collect()
    assert [(r["attack_type"], r["tp"], r["fn"], r["auc_roc"]) for r in rows] == [("x", 1, 1, 0.0)]


def fused(spark, rule, classifier, drift_value, risk, rule_type="benign"):
    df = spark.createDataFrame(
        [(rule, rule_type, classifier, drift_value, risk)],
        "rule_score double, rule_type string, classifier_score double, drift_score double, cascade_risk double",
    )
    return fusion.fuse(df).first()


def test_fusion(spark):
    row = fused(spark, 1.0, 0.0, 0.75, 1.0)
    assert row["is_injected"] and row["confidence"] == 0.5
    assert row["predicted_type"] == "unknown_injection"
    assert row["explanation"] == (
        "RBF matched benign pattern (score=1.00) | Semantic drift=0.75 (above threshold) | Cascade risk=1.00"
    )
    quiet = fused(spark, 0.15, 0.0, 0.5, 0.0, "direct_override")
    assert not quiet["is_injected"] and quiet["predicted_type"] == "direct_override"
    assert quiet["explanation"] == fv.NO_SIGNAL
    assert fused(spark, 0.0, 1.0, 0.0, 0.0)["explanation"] == "Classifier confidence=1.00"


def test_drift_range(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([-2.0, 0.0],), ([0.0, 3.0],), ([0.0, 0.0],), (None,)], "embedding array<float>")
    got = [r["drift_score"] for r in drift.score_drift(df, [5.0, 0.0]).collect()]
    assert got == [0.0, 1.0, 0.5, 0.5, 0.5]
    assert [r["drift_label"] for r in drift.score_drift(df, [5.0, 0.0]).collect()] == [0, 1, 0, 0, 0]


def test_rounding(spark):
    df = spark.createDataFrame([(0.12345,), (0.1 + 0.2,), (1.0,), (0.00005,)], "v double")
    assert [r[0] for r in df.select(round_to(F.col("v"), 4)).collect()] == [0.1235, 0.3, 1.0, 0.0001]


def test_previews_and_recent(spark):
    df = spark.createDataFrame(
        [(i, str(i), "x" * (119 + i), "a", "b", "t", 0.5, True) for i in range(1, 4)],
        "seq bigint, message_id string, content string, from_agent string, to_agent string, "
        "predicted_type string, confidence double, quarantined boolean",
    )
    previews = [r["content_preview"] for r in routing.audit_entries(df).orderBy("message_id").collect()]
    assert [len(p) for p in previews] == [120, 121, 121] and previews[1].endswith("…")
    recent = routing.recent_quarantined(df, 2).collect()
    assert [r["seq"] for r in recent] == [2, 3]
    kinds = {r["predicted_type"]: r["n"] for r in routing.quarantine_summary(df).collect()}
    assert kinds == {"total": 3, "t": 3}


def test_conversations_stop_at_the_first_block(spark):
    df = spark.createDataFrame(
        [("c", 1, False, "ok"), ("c", 2, True, "bad"), ("c", 3, True, "more"), ("d", 1, False, "")],
        "conv_id string, seq int, is_injected boolean, content string",
    ).withColumns({"predicted_type": F.lit("t"), "confidence": F.lit(0.6543), "explanation": F.lit("why"),
                   "message_id": F.col("content")})
    kept = routing.halt_downstream(df).orderBy("conv_id", "seq").collect()
    assert [(r["conv_id"], r["seq"], r["alert"] is not None) for r in kept] == [
        ("c", 1, False), ("c", 2, True), ("d", 1, False)]
    newest = routing.newest_messages(df, "conv_id", "seq")
    replies = {r["conv_id"]: r["reply"] for r in routing.guard_last_message(newest).collect()}
    assert replies["c"].startswith("[ALERT] Injection blocked.\n") and "65.43%" in replies["c"]
    assert "d" not in replies  # its newest message is blank


@pytest.fixture(scope="module")
def trained(spark):
    corpus = build_corpus(spark, 400, "m").cache()
    train, test = corpus.where("pmod(hash(message_id), 4) > 0"), corpus.where("pmod(hash(message_id), 4) = 0")
    return train, test, text_model.fit_logistic(train, limit=500)


def test_model_is_at_the_minimum(spark, trained):
    """Gradient of C * weighted log loss + |b|^2 / 2 at the fitted coefficients."""
    train, _, model = trained
    scored = model.transform(train).select("label", "_features").collect()
    x = np.array([r["_features"].toArray() for r in scored])
    y = np.array([r["label"] for r in scored])
    assert np.allclose(np.linalg.norm(x, axis=1), 1.0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    last = model.stages[-1]
    b, b0 = last.coefficients.toArray(), last.intercept

    def loss(c, c0):
        z = x @ c + c0
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * c @ c

    rng = np.random.default_rng(0)
    base = loss(b, b0)
    for _ in range(20):
        step = rng.normal(size=b.size) * 0.05
        assert loss(b + step, b0) > base - 1e-3
        assert loss(b, b0 + rng.normal() * 0.05) > base - 1e-3


def test_tfidf_agrees_with_the_model_features(spark, trained):
    train, _, model = trained
    names = model.stages[4].vocabulary
    weights = text_model.tfidf(train, "message_id", limit=500).collect()
    table = {}
    for r in weights:
        table.setdefault(r["message_id"], {})[r["term"]] = r["weight"]
    shared = 0
    for r in model.transform(train).select("message_id", "_features").collect():
        features = {names[i]: v for i, v in zip(r["_features"].indices, r["_features"].values)}
        ours = table.get(r["message_id"], {})
        if features.keys() == ours.keys():  # vocabularies may differ in ties
            shared += 1
            for term, value in features.items():
                assert value == pytest.approx(ours[term], abs=1e-9)
    assert shared > 100


@pytest.mark.parametrize("limit", [3, 8, 40, 500])
def test_top_ngrams_are_those_of_all(spark, limit):
    rng = random.Random(limit)
    texts = [" ".join(rng.choices(["aa", "ab", "ba", "bb", "cc"], [5, 4, 3, 2, 1], k=rng.randint(0, 9))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "content string")
    frame = text_model.word_ngrams(rows).select(F.explode("ngrams").alias("term"))
    every = [r["term"] for r in text_model.top_terms(frame, limit).collect()]
    assert text_model.top_ngrams(rows.select(F.split("content", " ").alias("_one")).select(
        F.array_remove("_one", "").alias("_one")), limit=limit) == every


def test_tfidf_adds_up_rows_of_one_id(spark):
    rows = [(1, "aa bb"), (None, "aa"), (1, "bb"), (2, None), (None, "aa cc"), (3, "")]
    found = {(r[0], r[1]): r[2] for r in text_model.tfidf(
        spark.createDataFrame(rows, "id int, content string"), "id").collect()}
    rare, common = np.log(7 / 2) + 1, np.log(7 / 3) + 1
    own = {"aa": common, "bb": (np.log(2) + 1) * rare, "aa bb": rare}
    other = {"aa": (np.log(2) + 1) * common, "cc": rare, "aa cc": rare}
    expected = {(i, t): v / np.linalg.norm(list(all_.values())) for i, all_ in [(1, own), (None, other)] for t, v in all_.items()}
    assert found == pytest.approx(expected)


def test_tfidf_neither_stores_nor_shuffles_a_documents_terms(spark):
    rows = spark.range(40).select("id", F.concat_ws(" ", F.transform(
        F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), (i * F.col("id")) % 7))).alias("content"))
    weights = text_model.tfidf(rows, "id", limit=200)
    plan = weights._jdf.queryExecution().optimizedPlan()
    assert "Window" not in plan.toString() and "Aggregate" not in plan.toString()
    assert weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).where("abs(n - 1) > 1e-9").isEmpty()


def test_saved_model_scores_alike(spark, trained, tmp_path):
    _, test, model = trained
    path = str(tmp_path / "model")
    text_model.save_model(model, path)
    again = text_model.load_model(path)
    a = {r[0]: r[1] for r in text_model.score_classifier(test, model).select("message_id", "classifier_score").collect()}
    b = {r[0]: r[1] for r in text_model.score_classifier(test, again).select("message_id", "classifier_score").collect()}
    assert a == b and all(0 <= v <= 1 for v in a.values())


def test_class_weights_leave_rows_in_their_tasks(spark):
    rows = spark.range(0, 800, 1, 8).select((F.col("id") % 10 == 0).cast("int").alias("label"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(limit)
    spark.conf.set(limit, -1)
    try:
        weighted = text_model.with_class_weight(rows)
        assert weighted.select(F.spark_partition_id()).distinct().count() == 8
        assert {(r[0], r[1]) for r in weighted.distinct().collect()} == {(1, 5.0), (0, 800 / 1440)}
    finally:
        spark.conf.set(limit, own)


def test_model_scores_after_an_observed_query(spark, trained):
    train, test, _ = trained
    model = text_model.fit_logistic(train, limit=100, max_iterations=2)
    seen = Observation("seen")
    assert spark.range(3).observe(seen, F.count("*").alias("n")).count() == 3 and seen.get["n"] == 3
    scored = text_model.score_classifier(test, model)
    assert scored.where("classifier_score BETWEEN 0 AND 1").count() == test.count()


def test_whole_system_on_held_out_messages(spark, trained):
    _, test, model = trained
    layers = Layers(classifier=classifier_from_model(model), drift=drift_from_text())
    rows = {r["system"]: r for r in baseline_comparison(test, layers=layers, text_model=model).collect()}
    assert len(rows) == 6
    none = rows["B0: No Protection"]
    assert (none["fpr"], none["f1"], none["auc_roc"]) == (0.0, 0.0, 0.0)
    assert rows["B2: TF-IDF + LR"]["f1"] > 0.9
    gains = metrics.improvement(spark.createDataFrame(list(rows.values())), "B5: Full System").collect()
    assert len(gains) == 5


def test_detect_does_not_depend_on_partitions(spark):
    messages = build_corpus(spark, 120, "p").withColumn("seq", F.col("message_id").cast("bigint"))
    layers = Layers(drift=constant_drift())
    results = []
    for count in ["1", "50"]:
        spark.conf.set("spark.sql.shuffle.partitions", count)
        results.append(sorted(detect(messages, layers).collect(), key=lambda r: r["seq"]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
    assert all(0 <= r["confidence"] <= 1 for r in results[0])


def test_comparison_fits_its_regression_on_the_other_half(spark):
    """Without a model of its own the comparison has six systems, each on all messages."""
    rows = [(str(i), i, ("ignore the old rules " if i % 3 else "the weather is fine ") + f"word{i % 7}", "a", f"b{i % 4}", int(i % 3 > 0))
            for i in range(60)]
    messages = spark.createDataFrame([*rows, ("none", 60, None, "a", "b0", 0)],
                                     "message_id string, seq long, content string, from_agent string, to_agent string, label int")
    found = {r["system"]: r for r in baseline_comparison(messages, layers=Layers(drift=constant_drift()), held_out=True).collect()}
    fitted = found["B2: TF-IDF + LR"]
    assert len(found) == 6 and sum(fitted[c] for c in ("tp", "fp", "fn", "tn")) == 61
    assert fitted["f1"] > 0.9
    scored = {r["message_id"]: r for r in held_out_scores(messages).collect()}
    assert len(scored) == 61 and scored["none"]["content"] is None
    half = {r[0]: r[1] for r in messages.select("message_id", pick_number(F.col("message_id"), "half", 2)).collect()}
    first = [i for i in half if half[i] == 0]
    texts = messages.fillna("", ["content"])
    model = text_model.fit_logistic(texts.where(~F.col("message_id").isin(first)), tolerance=1e-9)
    for r in text_model.score_classifier(texts.where(F.col("message_id").isin(first)), model).collect():
        assert scored[r["message_id"]]["text_score"] == pytest.approx(r["classifier_score"], abs=1e-9)
    one_class = held_out_scores(messages.where("label = 1"))
    assert one_class.where("text_label = 0 AND text_score = 0").count() == 40
