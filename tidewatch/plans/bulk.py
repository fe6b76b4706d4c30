"""Health checks over the stored tables: queue, run many, store results, reports and job events."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.baseline import BaselineIndex, baseline_index
from tidewatch.operators.drift import DriftThresholds
from tidewatch.operators.jobs import (
    FAILED,
    JOB_TYPE,
    QUEUED,
    RUNNING,
    finish_events,
    held_leases,
    job_event,
    job_states,
    queue_checks,
    start_events,
)
from tidewatch.operators.metrics import LOW_CONFIDENCE
from tidewatch.plans.health_check import (
    CheckRun,
    detail_table,
    diagnosis_report_table,
    health_check_table,
    job_results,
    of_owners,
    run_checks,
)
from tidewatch.plans.ingest import NO_PROJECT
from tidewatch.session import as_small_side, cut_lineage
from tidewatch.sources.tables import Store

# The ids a queued check carries.
PAYLOAD = "model_version_id BIGINT, baseline_dataset_id BIGINT, prediction_batch_id BIGINT"


def _stored_rows(store: Store, table: str, owner: str, registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted ids, read from the folders of the loads that hold them."""
    listed = registry.select(F.col("id").alias(owner), "load_id")
    places = as_small_side(wanted.distinct().join(listed, owner).select("load_id", owner))
    return of_owners(store.read(table), ["load_id", owner], places)


def stored_index(store: Store, datasets: DataFrame, wanted: DataFrame) -> BaselineIndex:
    """The index of the wanted baselines (``dataset_id``) as it was kept when they were loaded.

    Slices are read in their buckets, so a join with them moves only the other side. Datasets
    whose rows were stored without an index are indexed from their rows.
    """
    listed = datasets.select(F.col("id").alias("dataset_id"), "load_id")
    places = as_small_side(wanted.distinct().join(listed, "dataset_id").select("load_id", "dataset_id"))
    of_load = ["load_id", "dataset_id"]
    features = cut_lineage(of_owners(store.read("baseline_features"), of_load, places).drop("load_id"))
    ends = places.agg(*[f(c).alias(f"{n}_{c}") for c in of_load for n, f in (("low", F.min), ("high", F.max))]).first()
    slices = store.read_buckets("baseline_slices")
    for c in of_load:
        slices = slices.where(F.col(c).between(ends[f"low_{c}"], ends[f"high_{c}"]))
    categories = of_owners(store.read("baseline_categories"), of_load, places)
    index = BaselineIndex(features, slices.drop("load_id"), categories.drop("load_id"))
    unindexed = places.join(features.select("dataset_id").distinct(), "dataset_id", "left_anti")
    if unindexed.isEmpty():
        return index
    rows = of_owners(store.read("dataset_rows"), of_load, as_small_side(unindexed.select(*of_load)))
    return index.union(baseline_index(rows.select("dataset_id", "features")))


def run_stored(
    store: Store, requests: DataFrame, limits: DriftThresholds = DriftThresholds(), low_confidence: float = LOW_CONFIDENCE
) -> CheckRun:
    """Run requests against the store; folders of other loads are not read."""
    datasets, batches = store.read("datasets"), store.read("prediction_batches")
    baselines = requests.select(F.col("baseline_dataset_id").alias("dataset_id"))
    checked = requests.select(F.col("prediction_batch_id").alias("batch_id"))
    return run_checks(
        requests,
        store.read("projects"),
        store.read("model_versions"),
        datasets,
        batches,
        stored_index(store, datasets, baselines),
        _stored_rows(store, "predictions", "batch_id", batches, checked),
        limits,
        low_confidence,
    )


def queue_jobs(store: Store, requests: DataFrame, at: Column) -> DataFrame:
    """Queue requests (check_id, project_id and the three ids) as jobs; returns the refused ones.

    A request for an unknown project is refused before a job exists. A request whose job exists
    is left as it is, so queueing the same requests again changes nothing.
    """
    projects = store.read("projects").select(F.col("id").alias("project_id"), F.lit(True).alias("has_project"))
    judged = cut_lineage(requests.join(projects, "project_id", "left"))
    jobs = judged.where("has_project").drop("has_project").withColumnRenamed("check_id", "job_id")
    store.append_once("job_events", queue_checks(jobs, at), "job_id")
    message = F.format_string(NO_PROJECT, F.col("project_id").cast("string"))
    return judged.where("has_project IS NULL").select("check_id", "project_id", message.alias("error"))


def open_requests(store: Store) -> DataFrame:
    """Requests of the jobs that wait, or that a run began and did not end."""
    events = store.read("job_events")
    waiting = job_states(events).where(F.col("status").isin(QUEUED, RUNNING)).select("job_id")
    return (
        events.where("payload IS NOT NULL")
        .join(waiting, "job_id", "left_semi")
        .select(F.col("job_id").alias("check_id"), "project_id", F.from_json("payload", PAYLOAD).alias("ids"))
        .select("check_id", "project_id", "ids.*")
        .dropDuplicates(["check_id"])
    )


def _moment(seconds: float = 0.0) -> tuple[datetime, Column]:
    at = datetime.now(UTC) + timedelta(seconds=seconds)
    return at, F.lit(at).cast("timestamp")


def claim(store: Store, jobs: DataFrame, owner: int, lease_seconds: float, settle_seconds: float) -> DataFrame:
    """Those of the jobs (``job_id``) whose lease this owner won.

    Every run asks for the jobs that nobody holds, waits until the requests of others can be seen,
    and reads who asked first. A request that took longer to write than others wait is given back
    and made anew. Clocks may differ by less than the wait.
    """
    while True:
        asked, at = _moment()
        held = held_leases(store.read("job_leases"), at).where(F.col("owner") != owner)
        free = cut_lineage(jobs.select("job_id").join(held, "job_id", "left_anti"))
        _, until = _moment(lease_seconds)
        store.append("job_leases", free.select("job_id", F.lit(owner).alias("owner"), at.alias("asked_at"), until.alias("until")))
        if datetime.now(UTC) - asked < timedelta(seconds=settle_seconds):
            break
        give_back(store, free, owner)
        settle_seconds *= 2
    time.sleep(settle_seconds)
    _, now = _moment()
    won = held_leases(store.read("job_leases"), now).where(F.col("owner") == owner)
    return cut_lineage(free.join(won, "job_id", "left_semi"))


def give_back(store: Store, jobs: DataFrame, owner: int) -> None:
    """End this owner's leases of the jobs."""
    _, now = _moment()
    store.append("job_leases", jobs.select("job_id", F.lit(owner).alias("owner"), now.alias("asked_at"), now.alias("until")))


def run_queued(
    store: Store,
    at: Column,
    limits: DriftThresholds = DriftThresholds(),
    low_confidence: float = LOW_CONFIDENCE,
    lease_seconds: float = 3600.0,
    settle_seconds: float = 2.0,
) -> DataFrame:
    """Run all open jobs whose lease this run wins; returns the outcome per job.

    Any number of runs may work on a store: each takes jobs that no other one holds. A failing
    check becomes ``failed`` with its message; the others go on. If the run itself fails, its jobs
    become ``failed`` with the error, which is raised again. Jobs of a run that died without a word
    are still ``running`` and are taken up once its lease has ended; what it had stored is not stored
    again, because every table takes a check's rows once.
    """
    run_id = uuid.uuid4().int >> 66
    open_jobs = cut_lineage(open_requests(store))
    won = claim(store, open_jobs.select(F.col("check_id").alias("job_id")), run_id, lease_seconds, settle_seconds)
    try:
        # A job may have ended between its listing and its lease.
        requests = cut_lineage(open_requests(store).join(won.withColumnRenamed("job_id", "check_id"), "check_id", "left_semi"))
        jobs = requests.withColumnRenamed("check_id", "job_id")
        earlier = _earlier_runs(store, jobs)
        store.append("job_events", start_events(jobs, at).withColumn("run_id", F.lit(run_id)))
        try:
            return _run(store, requests, at, limits, low_confidence, run_id, earlier)
        except Exception as error:
            reason = F.lit(f"{type(error).__name__}: {error}"[:2000])
            failed = jobs.select("job_id", "project_id", F.lit(JOB_TYPE).alias("job_type"), *job_event(FAILED, at, reason))
            store.append("job_events", failed)
            raise
    finally:
        give_back(store, won, run_id)


def _earlier_runs(store: Store, jobs: DataFrame) -> list[int]:
    """Runs that began some of the open jobs and did not end them: as many as runs that died."""
    begun = store.read("job_events").where("run_id IS NOT NULL").join(jobs.select("job_id"), "job_id", "left_semi")
    return [row["run_id"] for row in begun.select("run_id").distinct().toLocalIterator()]


def _run(
    store: Store, requests: DataFrame, at: Column, limits: DriftThresholds, low_confidence: float, run_id: int, earlier: list[int]
) -> DataFrame:
    run = run_stored(store, requests, limits, low_confidence)
    details = {"features": run.features, "categories": run.categories, "classes": run.classes, "confusion": run.confusion}
    # Details first: a check is listed once all of its details are stored.
    for name, rows in details.items():
        store.store_run(f"check_{name}", detail_table(rows, at), "health_check_id", run_id, earlier)
    store.store_run("diagnosis_reports", diagnosis_report_table(run.results, at), "id", run_id, earlier)
    store.store_run("health_checks", health_check_table(run.results, at), "id", run_id, earlier)
    outcome = job_results(run.results)
    finished = finish_events(outcome, at).join(requests.select(F.col("check_id").alias("job_id"), "project_id"), "job_id", "left")
    store.append("job_events", finished)
    return outcome


def run_and_store(store: Store, requests: DataFrame, at: Column, **settings) -> DataFrame:
    """Queue requests and run everything that is open."""
    queue_jobs(store, requests, at)
    return run_queued(store, at, **settings)
