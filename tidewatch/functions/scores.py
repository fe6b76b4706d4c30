"""Health scores as column expressions over one row per check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component weights, in order of evaluation.
WEIGHTS = {
    "performance": 0.35,
    "drift": 0.25,
    "data_quality": 0.20,
    "confidence": 0.10,
    "class_balance": 0.10,
}

# Lowest score of each status band.
STATUS_BANDS = [("excellent", 90), ("good", 75), ("warning", 60), ("risky", 40)]
LOWEST_STATUS = "critical"

# Fixed value: the component score used when its measure is unknown.
UNKNOWN_SCORE = 50.0


def performance_score(f1: Column, accuracy: Column) -> Column:
    return F.coalesce(f1 * 100, accuracy * 100, F.lit(UNKNOWN_SCORE))


def drift_score(drift_rate: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 * (1 - F.coalesce(drift_rate, F.lit(0.0))))


def data_quality_score(missing_rate: Column) -> Column:
    return 100 * (1 - F.least(F.greatest(missing_rate, F.lit(0.0)), F.lit(1.0)))


def confidence_score(average_confidence: Column) -> Column:
    return F.coalesce(average_confidence * 100, F.lit(UNKNOWN_SCORE))


def class_balance_score(minimum_share: Column, maximum_share: Column, class_count: Column) -> Column:
    """Smallest over largest class share; a single class has no balance at all."""
    return (
        F.when(F.coalesce(class_count, F.lit(0)) == 0, UNKNOWN_SCORE)
        .when((class_count == 1) | (maximum_share == 0), 0.0)
        .otherwise(F.least(F.lit(100.0), minimum_share / maximum_share * 100))
    )


def health_status(score: Column) -> Column:
    chain = None
    for name, lowest in STATUS_BANDS:
        chain = F.when(score >= lowest, name) if chain is None else chain.when(score >= lowest, name)
    return chain.otherwise(LOWEST_STATUS)


def score_error(score: Column, name: str) -> Column:
    """The reason a component score is unusable, NULL when it lies in 0..100."""
    valid = score.isNotNull() & ~F.isnan(score) & score.between(0, 100)
    return F.when(~valid, f"{name} must be between 0 and 100.")


def weighted_score(components: dict[str, Column]) -> Column:
    """Weighted sum of the component scores, rounded to two places."""
    total = None
    for name, weight in WEIGHTS.items():
        term = components[name] * weight
        total = term if total is None else total + term
    return F.round(total, 2)
