"""Background job history: status events are appended, the current state is folded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states a job passes through.
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"
JOB_TYPE = "model_health_check"


def job_event(status: str, at: Column, error: Column | None = None) -> list[Column]:
    """The columns every status event carries."""
    return [
        F.lit(status).alias("status"),
        at.alias("event_at"),
        (F.lit(None) if error is None else error).cast("string").alias("error_message"),
    ]


def queue_checks(requests: DataFrame, at: Column) -> DataFrame:
    """``queued`` events for health-check requests (job_id, project_id and the payload ids)."""
    payload = F.to_json(F.struct("model_version_id", "baseline_dataset_id", "prediction_batch_id"))
    return requests.select(
        "job_id", "project_id", F.lit(JOB_TYPE).alias("job_type"), payload.alias("payload"), *job_event(QUEUED, at)
    )


def start_events(requests: DataFrame, at: Column) -> DataFrame:
    """``running`` events of queued jobs."""
    return requests.select("job_id", "project_id", F.lit(JOB_TYPE).alias("job_type"), *job_event(RUNNING, at))


def finish_events(results: DataFrame, at: Column) -> DataFrame:
    """``completed`` or ``failed`` events from the outcome rows of a bulk run."""
    done = F.col("error_message").isNull()
    result = F.to_json(
        F.struct(
            "health_check_id",
            "diagnosis_report_id",
            "health_score",
            "status",
            "risk_level",
            "retraining_recommended",
        )
    )
    return results.select(
        F.col("check_id").alias("job_id"),
        F.when(done, COMPLETED).otherwise(FAILED).alias("status"),
        at.alias("event_at"),
        "error_message",
        F.when(done, result).otherwise("{}").alias("result"),
    )


def job_states(events: DataFrame, order: list[str] = ("event_at",)) -> DataFrame:
    """Current state per job by partial aggregates: latest status, stamps, duration, last error.

    A restart clears the error, as does completion, so the error is the latest event's.
    """
    stage = F.when(F.col("status") == QUEUED, 0).when(F.col("status") == RUNNING, 1).otherwise(2)
    position = F.struct(*order, stage)
    ended = F.col("status").isin(COMPLETED, FAILED)
    return (
        events.groupBy("job_id")
        .agg(
            F.max_by("status", position).alias("status"),
            F.min("event_at").alias("created_at"),
            F.max(F.when(F.col("status") == RUNNING, F.col("event_at"))).alias("started_at"),
            F.max(F.when(ended, F.col("event_at"))).alias("finished_at"),
            F.max_by("error_message", position).alias("error_message"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .withColumn(
            "duration_seconds",
            F.unix_micros(F.col("finished_at").cast("timestamp")) / F.lit(1e6)
            - F.unix_micros(F.col("started_at").cast("timestamp")) / F.lit(1e6),
        )
    )


def held_leases(leases: DataFrame, now: Column) -> DataFrame:
    """``(job_id, owner, until)`` of the leases that hold: of those that run, the one asked for first.

    ``leases`` has a row per request (job_id, owner, asked_at, until). An owner's last row for a job
    counts, so a lease is given back by a row that ends at once.
    """
    last = leases.groupBy("job_id", "owner").agg(
        F.min("asked_at").alias("asked_at"), F.max_by("until", F.struct("asked_at", F.col("until").isNull())).alias("until")
    )
    running = last.where(F.col("until") > now)
    return running.groupBy("job_id").agg(F.min(F.struct("asked_at", "owner", "until")).alias("first")).select(
        "job_id", "first.owner", "first.until"
    )
