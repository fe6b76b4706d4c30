"""Dashboard rows for all projects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.registry import latest_per_group, newest_per_group

RECENT_JOBS = 5


def project_counts(projects: DataFrame, children: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """Number of rows of each child table per project, 0 where there are none.

    Each child is counted before it meets the projects, so only one row per project is joined.
    """
    result = projects
    for name, child in children.items():
        counted = child.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        result = result.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return result


def latest_health(health_checks: DataFrame, diagnosis_reports: DataFrame) -> DataFrame:
    """Newest check of every project with its report; no report leaves the report fields empty."""
    newest = latest_per_group(health_checks, ["project_id"])
    reports = diagnosis_reports.select("health_check_id", "risk_level", "retraining_recommended", "recommendations")
    return newest.withColumnRenamed("id", "health_check_id").join(reports, "health_check_id", "left").withColumns(
        {
            "drifted_features": F.coalesce("drift.drifted_features", F.array().cast("array<string>")),
            "recommendations": F.coalesce("recommendations", F.array().cast("array<string>")),
        }
    )


def recent_jobs(jobs: DataFrame, count: int = RECENT_JOBS) -> DataFrame:
    """The newest jobs of each project as they appear on the dashboard."""
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    return newest_per_group(jobs, ["project_id"], count).select(
        "project_id",
        "rank",
        "id",
        "job_type",
        "status",
        F.date_format("created_at", iso).alias("created_at"),
        F.date_format("finished_at", iso).alias("finished_at"),
    )


def project_dashboard(
    projects: DataFrame,
    model_versions: DataFrame,
    datasets: DataFrame,
    prediction_batches: DataFrame,
    health_checks: DataFrame,
    diagnosis_reports: DataFrame,
    jobs: DataFrame,
) -> DataFrame:
    """One row per project: counts, latest health and the five newest jobs."""
    base = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    counted = project_counts(
        base,
        {
            "models": model_versions,
            "datasets": datasets,
            "prediction_batches": prediction_batches,
            "health_checks": health_checks,
        },
    )
    health = latest_health(health_checks, diagnosis_reports).select(
        "project_id",
        F.struct(
            "health_check_id",
            "health_score",
            "status",
            "risk_level",
            "retraining_recommended",
            "metrics",
            "component_scores",
            "drifted_features",
            "recommendations",
            "created_at",
        ).alias("latest_health"),
    )
    listed = recent_jobs(jobs)
    gathered = listed.groupBy("project_id").agg(
        F.sort_array(
            F.collect_list(F.struct("rank", "id", "job_type", "status", "created_at", "finished_at"))
        ).alias("recent_jobs")
    )
    return counted.join(health, "project_id", "left").join(gathered, "project_id", "left")
