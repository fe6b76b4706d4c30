"""Scores, status bands and diagnosis rules."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores
from tidewatch.operators import health

COLUMNS = (
    "f1 double, accuracy double, average_confidence double, low_confidence_rate double, minimum_share double, "
    "maximum_share double, class_count long, drift_rate double, drifted_features array<string>, missing_rate double"
)


def measured(spark, **values):
    base = dict(
        f1=0.8, accuracy=0.8, average_confidence=0.9, low_confidence_rate=0.05, minimum_share=0.5, maximum_share=0.5,
        class_count=2, drift_rate=0.2, drifted_features=[], missing_rate=0.05,
    )
    base.update(values)
    return spark.createDataFrame([tuple(base.values())], COLUMNS)


def test_weighted_score(spark):
    row = health.health_score(
        spark.createDataFrame(
            [(90.0, 80.0, 100.0, 85.0, 100.0)],
            "performance_score double, drift_score double, data_quality_score double, confidence_score double, class_balance_score double",
        )
    ).first()
    assert (row["health_score"], row["status"]) == (90.0, "excellent")


def test_status_bands(spark):
    frame = spark.createDataFrame([(95.0,), (90.0,), (80.0,), (65.0,), (50.0,), (30.0,)], "s double")
    found = [r[0] for r in frame.select(scores.health_status(F.col("s"))).collect()]
    assert found == ["excellent", "excellent", "good", "warning", "risky", "critical"]


def components(frame):
    row = health.component_scores(frame).first()
    return [row[f"{c}_score"] for c in scores.WEIGHTS]


def test_components(spark):
    assert components(measured(spark)) == [80.0, 80.0, 95.0, 90.0, 100.0]
    assert components(measured(spark, f1=None))[0] == 80.0
    unknown = components(measured(spark, f1=None, accuracy=None, average_confidence=None, class_count=0))
    assert (unknown[0], unknown[3], unknown[4]) == (50.0, 50.0, 50.0)
    assert components(measured(spark, class_count=1, minimum_share=1.0, maximum_share=1.0))[4] == 0.0
    assert components(measured(spark, minimum_share=0.2, maximum_share=0.8))[4] == 25.0
    assert components(measured(spark, missing_rate=1.5, drift_rate=1.2))[1:3] == [0.0, 0.0]


def test_out_of_range_component(spark):
    row = health.health_score(health.component_scores(measured(spark, average_confidence=1.2))).first()
    assert row["score_error"] == "confidence_score must be between 0 and 100."
    assert row["health_score"] is None


def diagnose(frame, score):
    rated = frame.withColumn("health_score", F.lit(score)).withColumn("status", scores.health_status(F.lit(score)))
    return health.diagnosis(rated).first()


def test_unhealthy_model(spark):
    row = diagnose(
        measured(
            spark, f1=0.6, average_confidence=0.65, low_confidence_rate=0.3, minimum_share=0.15, maximum_share=0.85,
            drifted_features=["age", "monthly_charges"], missing_rate=0.1,
        ),
        55.0,
    )
    codes = [f["code"] for f in row["findings"]]
    assert codes == [
        "LOW_F1", "FEATURE_DRIFT", "LOW_CONFIDENCE", "HIGH_LOW_CONFIDENCE_RATE", "MISSING_VALUES", "CLASS_IMBALANCE",
    ]
    assert row["findings"][1]["message"] == "Feature drift was detected in: age, monthly_charges."
    assert (row["risk_level"], row["retraining_recommended"], len(row["recommendations"])) == ("high", True, 6)
    assert row["summary"] == (
        "Model health score is 55.00/100 with status 'risky'. The diagnosis engine produced 6 finding(s)."
    )


def test_healthy_model(spark):
    row = diagnose(measured(spark, f1=0.9, average_confidence=0.88, missing_rate=0.0), 91.0)
    assert [f["code"] for f in row["findings"]] == ["HEALTHY_MODEL"]
    assert (row["risk_level"], row["retraining_recommended"]) == ("low", False)


@pytest.mark.parametrize("score, risk", [(39.9, "critical"), (40.0, "high"), (60.0, "medium"), (75.0, "low")])
def test_risk_by_score(spark, score, risk):
    assert diagnose(measured(spark), score)["risk_level"] == risk


def test_limits_are_strict(spark):
    row = diagnose(
        measured(spark, f1=0.7, average_confidence=0.7, low_confidence_rate=0.2, minimum_share=0.2, missing_rate=0.05), 80.0
    )
    assert [f["code"] for f in row["findings"]] == ["HEALTHY_MODEL"]


def test_single_class_is_no_imbalance_finding(spark):
    row = diagnose(measured(spark, class_count=1, minimum_share=1.0, maximum_share=1.0), 80.0)
    assert "CLASS_IMBALANCE" not in [f["code"] for f in row["findings"]]
