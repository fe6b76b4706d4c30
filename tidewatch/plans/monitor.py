"""The monitoring API: register, list, look up, delete, and read dashboards of one store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import dashboard
from tidewatch.operators.jobs import job_states
from tidewatch.operators.registry import (
    first_of_each,
    latest_per_group,
    length_violations,
    newest_first,
    oldest_first,
    where_equal,
)
from tidewatch.plans.ingest import NO_PROJECT, Load
from tidewatch.session import cut_lineage
from tidewatch.sources.tables import MODEL_LENGTHS, PROBLEM_TYPES, PROJECT_LENGTHS, SCHEMAS, Store

# Defaults, and the smallest, usual and largest length of a job listing.
METRIC_PRIORITY = "f1"
REGISTERED = "registered"
JOB_LIMITS = (1, 100, 500)

# Messages of refused registrations.
BAD_LENGTH = " has an invalid length."
UNKNOWN_PROBLEM = "Unknown problem type."
KNOWN_PROJECT = "Project with name '%s' already exists."
KNOWN_MODEL = "Model '%s' version '%s' already exists in project %s."


class NotFound(LookupError):
    """A looked-up row does not exist."""


def _with_defaults(store: Store, table: str, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows with every column of the table; absent and empty ones take their default."""
    wanted = store.spark.createDataFrame([], SCHEMAS[table])
    for field in wanted.schema:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows.withColumns({c: F.coalesce(F.col(c), default) for c, default in defaults.items()})


def _register(
    store: Store, table: str, rows: DataFrame, identity: list[str], problem: Column, known_error: Column, at: Column
) -> Load:
    """Append the valid first row of each new identity; the others are refused with a reason."""
    stamped = rows.withColumns({"created_at": at, "updated_at": at, "row_no": F.monotonically_increasing_id()})
    judged = cut_lineage(stamped.withColumn("problem", problem))
    known = store.read(table).select(*identity).distinct().withColumn("is_known", F.lit(True))
    valid = judged.where("problem IS NULL")
    firsts = first_of_each(valid.select(*identity, "row_no"), identity, ["row_no"]).select(
        "row_no", F.lit(True).alias("is_first")
    )
    decided = cut_lineage(
        judged.join(known, identity, "left")
        .join(firsts, "row_no", "left")
        .withColumn(
            "error",
            F.when(F.col("problem").isNotNull(), F.col("problem")).when(
                F.col("is_known").isNotNull() | F.col("is_first").isNull(), known_error
            ),
        )
        .withColumn("id", F.xxhash64(*identity, F.lit("created_at"), "created_at"))
    )
    accepted = decided.where("error IS NULL").select(*store.spark.createDataFrame([], SCHEMAS[table]).columns)
    store.append(table, accepted)
    return Load(accepted, decided.where("error IS NOT NULL").select(*identity, "error"))


class Monitor:
    """Lookups are DataFrames over the store; a missing parent raises ``NotFound``."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def _one(self, table: str, kind: str, id_: int) -> DataFrame:
        row = where_equal(self.store.read(table), id=id_)
        if row.isEmpty():
            raise NotFound(f"{kind} with ID {id_} was not found.")
        return row

    # --- registering and deleting ---------------------------------------------------------

    def register_projects(self, projects: DataFrame, at: Column) -> Load:
        rows = _with_defaults(self.store, "projects", projects, {"metric_priority": F.lit(METRIC_PRIORITY)})
        field = length_violations(PROJECT_LENGTHS)
        problem = F.when(field.isNotNull(), F.concat(field, F.lit(BAD_LENGTH))).when(
            ~F.coalesce(F.col("problem_type").isin(PROBLEM_TYPES), F.lit(False)), UNKNOWN_PROBLEM
        )
        taken = F.format_string(KNOWN_PROJECT, "name")
        return _register(self.store, "projects", rows, ["name"], problem, taken, at)

    def register_model_versions(self, models: DataFrame, at: Column) -> Load:
        rows = _with_defaults(self.store, "model_versions", models, {"status": F.lit(REGISTERED)})
        projects = self.store.read("projects").select(F.col("id").alias("project_id"), F.lit(True).alias("has_project"))
        field = length_violations(MODEL_LENGTHS)
        problem = F.when(
            F.col("has_project").isNull(),
            F.format_string(NO_PROJECT, F.col("project_id").cast("string")),
        ).when(field.isNotNull(), F.concat(field, F.lit(BAD_LENGTH)))
        taken = F.format_string(KNOWN_MODEL, "name", "version", F.col("project_id").cast("string"))
        identity = ["project_id", "name", "version"]
        return _register(
            self.store, "model_versions", rows.join(projects, "project_id", "left"), identity, problem, taken, at
        )

    def delete_project(self, project_id: int, at: Column) -> None:
        self.store.delete("projects", self._one("projects", "Project", project_id), at)

    def delete_model_version(self, model_id: int, at: Column) -> None:
        self.store.delete("model_versions", self._one("model_versions", "Model version", model_id), at)

    # --- listings and details -------------------------------------------------------------

    def projects(self) -> DataFrame:
        return newest_first(self.store.read("projects"))

    def project(self, project_id: int) -> DataFrame:
        return self._one("projects", "Project", project_id)

    def _of_project(self, table: str, project_id: int, stamp: str = "created_at") -> DataFrame:
        self.project(project_id)
        return newest_first(where_equal(self.store.read(table), project_id=project_id), stamp)

    def models(self, project_id: int) -> DataFrame:
        return self._of_project("model_versions", project_id)

    def model(self, model_id: int) -> DataFrame:
        return self._one("model_versions", "Model version", model_id)

    def datasets(self, project_id: int) -> DataFrame:
        return self._of_project("datasets", project_id)

    def dataset_profile(self, dataset_id: int) -> DataFrame:
        dataset = self._one("datasets", "Dataset", dataset_id).select(F.col("id").alias("dataset_id"), "version")
        return dataset.join(where_equal(self.store.read("dataset_profiles"), dataset_id=dataset_id), "dataset_id")

    def dataset_classes(self, dataset_id: int) -> DataFrame:
        self._one("datasets", "Dataset", dataset_id)
        return where_equal(self.store.read("dataset_classes"), dataset_id=dataset_id)

    def batches(self, project_id: int) -> DataFrame:
        return self._of_project("prediction_batches", project_id, "uploaded_at")

    def batch_predictions(self, batch_id: int) -> DataFrame:
        """Predictions of a batch in row order; only the folder of its load is read."""
        batch = self._one("prediction_batches", "Prediction batch", batch_id).first()
        place = {"project_id": batch["project_id"], "load_id": batch["load_id"], "batch_id": batch_id}
        return oldest_first(where_equal(self.store.read("predictions"), **place), "row_id")

    def jobs(self, limit: int = JOB_LIMITS[1]) -> DataFrame:
        if not JOB_LIMITS[0] <= limit <= JOB_LIMITS[2]:
            raise ValueError(f"The limit must be between {JOB_LIMITS[0]} and {JOB_LIMITS[2]}.")
        return newest_first(job_states(self.store.read("job_events")), limit=limit, id_column="job_id")

    def job(self, job_id: int) -> DataFrame:
        events = where_equal(self.store.read("job_events"), job_id=job_id)
        if events.isEmpty():
            raise NotFound(f"Automation job with ID {job_id} was not found.")
        return job_states(events)

    # --- health and dashboards ------------------------------------------------------------

    def latest_health(self, project_id: int) -> DataFrame:
        self.project(project_id)
        checks = where_equal(self.store.read("health_checks"), project_id=project_id)
        if checks.isEmpty():
            raise NotFound(f"No health check exists for project {project_id}.")
        return latest_per_group(checks, ["project_id"])

    def report(self, health_check_id: int) -> DataFrame:
        self._one("health_checks", "Health check", health_check_id)
        report = where_equal(self.store.read("diagnosis_reports"), health_check_id=health_check_id)
        if report.isEmpty():
            raise NotFound(f"Diagnosis report for health check {health_check_id} was not found.")
        return report

    def check_details(self, health_check_id: int, kind: str) -> DataFrame:
        """``features``, ``categories``, ``classes`` or ``confusion`` cells of a check."""
        self._one("health_checks", "Health check", health_check_id)
        return where_equal(self.store.read(f"check_{kind}"), health_check_id=health_check_id)

    def dashboards(self) -> DataFrame:
        """One row per project."""
        read = self.store.read
        owners = read("job_events").groupBy("job_id").agg(F.max("project_id").alias("project_id"), F.max("job_type").alias("job_type"))
        jobs = job_states(read("job_events")).join(owners, "job_id").withColumnRenamed("job_id", "id")
        return dashboard.project_dashboard(
            read("projects"),
            read("model_versions"),
            read("datasets"),
            read("prediction_batches"),
            read("health_checks"),
            read("diagnosis_reports"),
            jobs,
        )

    def dashboard(self, project_id: int) -> DataFrame:
        self.project(project_id)
        return where_equal(self.dashboards(), project_id=project_id)
