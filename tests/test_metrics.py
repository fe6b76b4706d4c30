"""Classification metrics on the ten-row demo log and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, ranking
from tidewatch.plans.health_check import check_tables

# The ten rows of the demo prediction log.
DEMO = [
    (25, 48.50, 4, "Month-to-month", 4, "1", "1", 0.91),
    (43, 78.20, 25, "One year", 1, "0", "0", 0.88),
    (37, 67.40, 13, "Month-to-month", 3, "1", "1", 0.82),
    (59, 91.25, 50, "Two year", 0, "0", "0", 0.95),
    (30, 58.10, 7, "Month-to-month", 5, "1", "1", 0.79),
    (48, 74.90, 38, "One year", 1, "0", "0", 0.87),
    (34, 63.80, 11, "Month-to-month", 2, "1", "0", 0.56),
    (52, 86.15, 44, "Two year", 0, "0", "0", 0.93),
    (28, 52.20, 5, "Month-to-month", 4, "1", "1", 0.84),
    (45, 77.60, 32, "One year", 1, "0", "0", 0.89),
]
SCHEMA = (
    "age int, monthly_charges double, tenure_months int, contract_type string, support_calls int, "
    "true_label string, predicted_label string, confidence double"
)


def demo(spark):
    return spark.createDataFrame(DEMO, SCHEMA)


def log(spark, rows, columns="true_label string, predicted_label string, confidence double"):
    return spark.createDataFrame(rows, columns)


def test_demo_log(spark):
    row = metrics.classification_metrics(demo(spark)).first()
    assert row["accuracy"] == pytest.approx(0.9)
    assert row["precision"] == pytest.approx(1.0)
    assert row["recall"] == pytest.approx(0.8)
    assert row["f1"] == pytest.approx(0.8888888889)
    assert row["average_confidence"] == pytest.approx(0.844)
    assert row["low_confidence_rate"] == pytest.approx(0.1)
    assert (row["minimum_confidence"], row["maximum_confidence"]) == (0.56, 0.95)
    assert (row["label_count"], row["positive_label"]) == (2, "1")
    matrix = {r["label"]: r["counts"] for r in metrics.dense_confusion(metrics.label_counts(demo(spark))).collect()}
    assert matrix == {"0": [5, 0], "1": [1, 4]}
    assert ranking.roc_auc(demo(spark)).first()["roc_auc"] == pytest.approx(0.12)
    totals = metrics.label_totals(metrics.label_counts(demo(spark)))
    shares = {c: {r["label"]: r["share"] for r in metrics.class_shares(totals, c).collect()} for c in ("support", "predicted")}
    assert shares == {"support": {"0": 0.5, "1": 0.5}, "predicted": {"0": 0.6, "1": 0.4}}


def test_demo_health(spark):
    """Three of five features drift: component scores and score of the demo."""
    log_rows = demo(spark)
    base = log_rows.drop("true_label", "predicted_label", "confidence")
    shifted = base.selectExpr("age + 100 age", "monthly_charges + 500 monthly_charges", "tenure_months + 90 tenure_months", "contract_type", "support_calls", "'x' churn")
    row = check_tables(shifted, log_rows, target="churn").first()
    assert row["drifted_features"] == ["age", "monthly_charges", "tenure_months"]
    scores = [row[f"{c}_score"] for c in ("performance", "drift", "data_quality", "confidence", "class_balance")]
    assert scores == [88.89, 40.0, 100.0, 84.4, 100.0]
    assert (row["health_score"], row["status"], row["risk_level"]) == (79.55, "good", "high")
    assert row["retraining_recommended"] is True


def test_a_check_without_values_has_no_score(spark):
    reference = spark.createDataFrame([(None,), (None,)], "x double")
    current = log(spark, [(1.0, "1", "1", 0.9), (2.0, "0", "0", 0.8)], "x double, true_label string, predicted_label string, confidence double")
    row = check_tables(reference, current).first()
    assert row["error_message"] == "Reference and current values must contain numeric data."
    assert row["health_score"] is None and row["accuracy"] == 1.0


def test_features_without_reference_count_as_cells(spark):
    reference = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    columns = "x double, extra string, true_label string, predicted_label string, confidence double"
    current = log(spark, [(1.0, None, "1", "1", 0.9), (None, "a", "0", "0", 0.8)], columns)
    row = check_tables(reference, current).first()
    assert row["feature_count"] == 1 and row["missing_rate"] == 0.5


def test_three_classes_are_weighted(spark):
    rows = [("a", "a", 0.9), ("a", "b", 0.8), ("b", "b", 0.7), ("c", "a", 0.6)]
    row = metrics.classification_metrics(log(spark, rows)).first()
    assert row["positive_label"] is None and row["label_count"] == 3
    assert row["precision"] == pytest.approx((0.5 * 2 + 0.5 * 1 + 0 * 1) / 4)
    assert row["recall"] == pytest.approx((0.5 * 2 + 1 * 1 + 0) / 4)
    assert ranking.roc_auc(log(spark, rows)).first()["roc_auc"] is None


def test_positive_class(spark):
    rows = [("x", "x", 0.9, "x"), ("x", "y", 0.8, "x"), ("y", "y", 0.7, "x")]
    columns = "true_label string, predicted_label string, confidence double, positive_class string"
    row = metrics.classification_metrics(log(spark, rows, columns)).first()
    assert (row["positive_label"], row["precision"], row["recall"]) == ("x", 1.0, 0.5)
    unknown = log(spark, [(t, p, c, "z") for t, p, c, _ in rows], columns)
    assert metrics.classification_metrics(unknown).first()["metric_error"] == "Positive class 'z' is not one of the labels."


def test_single_class(spark):
    row = metrics.classification_metrics(log(spark, [("1", "1", 0.9), ("1", "1", 0.8)])).first()
    assert (row["accuracy"], row["f1"], row["class_count"]) == (1.0, 1.0, 1)
    assert ranking.roc_auc(log(spark, [("1", "1", 0.9), ("1", "0", 0.8)])).first()["roc_auc"] is None


def test_partial_labels_and_confidences(spark):
    rows = [("1", "1", 0.9), (None, "0", None), ("0", "0", 0.2)]
    row = metrics.classification_metrics(log(spark, rows)).first()
    assert not row["fully_labeled"]
    assert row["accuracy"] is None and row["average_confidence"] is None
    assert row["minimum_share"] == pytest.approx(1 / 3)


def test_unlabeled_log_without_confidence(spark):
    row = metrics.classification_metrics(log(spark, [("a",), ("b",), ("b",)], "predicted_label string")).first()
    assert row["sample_count"] == 3 and row["f1"] is None
    assert (row["minimum_share"], row["maximum_share"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3))


def test_confidence_out_of_range(spark):
    row = metrics.classification_metrics(log(spark, [("1", "1", 1.2), ("0", "0", 0.5)])).first()
    assert row["metric_error"] == "Confidence values must be between 0 and 1."


@pytest.mark.parametrize("seed", range(3))
def test_auc_against_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    score = rng.integers(0, 20, 300) / 20
    true = rng.integers(0, 2, 300)
    pos, neg = score[true == 1], score[true == 0]
    expected = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    rows = [(str(t), str(t), float(s)) for t, s in zip(true, score)]
    assert ranking.roc_auc(log(spark, rows)).first()["roc_auc"] == pytest.approx(expected, rel=1e-12)
