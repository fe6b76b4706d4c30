"""Component scores, health score and rule-based diagnosis, one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scores

# The limits of the diagnosis rules.
LOW_F1 = 0.70
LOW_AVERAGE_CONFIDENCE = 0.70
HIGH_LOW_CONFIDENCE_RATE = 0.20
HIGH_MISSING_RATE = 0.05
SMALL_CLASS_SHARE = 0.20

# Code, severity, message and recommendation of each rule, in reporting order.
RULES = {
    "LOW_F1": (
        "high",
        "The model F1-score is below 0.70.",
        "Review misclassified examples and retrain the model with representative recent data.",
    ),
    "FEATURE_DRIFT": (
        "high",
        "Feature drift was detected in: %s.",
        "Investigate upstream data changes and compare recent feature distributions with the training baseline.",
    ),
    "LOW_CONFIDENCE": (
        "medium",
        "Average model confidence is below 0.70.",
        "Review low-confidence cases and evaluate probability calibration or decision-threshold adjustment.",
    ),
    "HIGH_LOW_CONFIDENCE_RATE": (
        "medium",
        "More than 20% of predictions have low confidence.",
        "Inspect noisy inputs and difficult prediction segments.",
    ),
    "MISSING_VALUES": (
        "medium",
        "More than 5% of current feature values are missing.",
        "Validate the upstream data pipeline and improve missing-value handling.",
    ),
    "CLASS_IMBALANCE": (
        "medium",
        "At least one class represents less than 20% of monitored records.",
        "Review minority-class recall and consider class weights, oversampling, or additional data collection.",
    ),
    "HEALTHY_MODEL": (
        "low",
        "No major performance, drift, confidence, or data-quality problem was detected.",
        "Continue monitoring the model with new prediction batches.",
    ),
}


def component_scores(df: DataFrame) -> DataFrame:
    """Add the five component scores, each rounded to two places."""
    col = F.col
    values = {
        "performance": scores.performance_score(col("f1"), col("accuracy")),
        "drift": scores.drift_score(col("drift_rate")),
        "data_quality": scores.data_quality_score(col("missing_rate")),
        "confidence": scores.confidence_score(col("average_confidence")),
        "class_balance": scores.class_balance_score(
            col("minimum_share"), col("maximum_share"), col("class_count")
        ),
    }
    return df.withColumns({f"{name}_score": F.round(value, 2) for name, value in values.items()})


def health_score(df: DataFrame) -> DataFrame:
    """Add score and status from the component scores, and the first out-of-range component."""
    columns = {name: F.col(f"{name}_score") for name in scores.WEIGHTS}
    errors = [scores.score_error(column, f"{name}_score") for name, column in columns.items()]
    return (
        df.withColumn("score_error", F.coalesce(*errors))
        .withColumn("health_score", F.when(F.col("score_error").isNull(), scores.weighted_score(columns)))
        .withColumn("status", F.when(F.col("health_score").isNotNull(), scores.health_status(F.col("health_score"))))
    )


def _finding(code: str, condition: Column, message: Column | None = None) -> Column:
    severity, text, advice = RULES[code]
    return F.when(
        condition,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            (F.lit(text) if message is None else message).alias("message"),
            F.lit(advice).alias("recommendation"),
        ),
    )


def risk_level(score: Column, findings: Column) -> Column:
    serious = F.exists(findings, lambda f: f["severity"] == "high")
    return (
        F.when(score < 40, "critical").when((score < 60) | serious, "high").when(score < 75, "medium").otherwise("low")
    )


def diagnosis(df: DataFrame) -> DataFrame:
    """Add findings, recommendations, risk level, retraining advice and the summary text."""
    col = F.col
    drifted = F.coalesce(col("drifted_features"), F.array().cast("array<string>"))
    rules = [
        _finding("LOW_F1", col("f1") < LOW_F1),
        _finding(
            "FEATURE_DRIFT",
            F.size(drifted) > 0,
            F.format_string(RULES["FEATURE_DRIFT"][1], F.array_join(drifted, ", ")),
        ),
        _finding("LOW_CONFIDENCE", col("average_confidence") < LOW_AVERAGE_CONFIDENCE),
        _finding("HIGH_LOW_CONFIDENCE_RATE", col("low_confidence_rate") > HIGH_LOW_CONFIDENCE_RATE),
        _finding("MISSING_VALUES", col("missing_rate") > HIGH_MISSING_RATE),
        _finding("CLASS_IMBALANCE", col("minimum_share") < SMALL_CLASS_SHARE),
    ]
    found = F.filter(F.array(*rules), lambda f: f.isNotNull())
    healthy = F.array(_finding("HEALTHY_MODEL", F.lit(True)))
    retrain_codes = ["LOW_F1", "FEATURE_DRIFT"]
    return (
        df.withColumn("rules", F.when(F.size(found) > 0, found).otherwise(healthy))
        .withColumn("risk_level", risk_level(col("health_score"), col("rules")))
        .withColumn(
            "retraining_recommended",
            col("risk_level").isin("high", "critical")
            | F.exists("rules", lambda f: f["code"].isin(retrain_codes)),
        )
        .withColumn(
            "summary",
            F.format_string(
                "Model health score is %.2f/100 with status '%s'. The diagnosis engine produced %d finding(s).",
                col("health_score"),
                col("status"),
                F.size("rules"),
            ),
        )
        .withColumn(
            "findings",
            F.transform("rules", lambda f: F.struct(f["code"].alias("code"), f["severity"].alias("severity"), f["message"].alias("message"))),
        )
        .withColumn("recommendations", F.array_distinct(F.transform("rules", lambda f: f["recommendation"])))
        .drop("rules")
    )


def finding_rows(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding of each report."""
    return reports.select(*keys, F.posexplode("findings").alias("position", "finding")).select(
        *keys, "position", "finding.code", "finding.severity", "finding.message"
    )
