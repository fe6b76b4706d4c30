"""The monitoring API from registration to dashboard and deletion."""

import pytest
from pyspark.sql import functions as F

from tests.test_tables import write
from tidewatch.operators.registry import listing_total
from tidewatch.plans import ingest, training
from tidewatch.plans.bulk import queue_jobs, run_queued
from tidewatch.plans.monitor import Monitor, NotFound
from tidewatch.sources.tables import Store


def at(second):
    return F.lit(f"2026-07-01 00:00:{second:02d}").cast("timestamp")


def test_life_of_a_project(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    monitor = Monitor(store)
    projects = spark.createDataFrame(
        [
            ("churn", "binary_classification", "churn", "1"),
            ("churn", "binary_classification", "other", None),
            ("ab", "binary_classification", "y", None),
            ("regress", "regression", "y", None),
        ],
        "name string, problem_type string, target_column string, positive_class string",
    )
    load = monitor.register_projects(projects, at(1))
    assert sorted(r["error"] for r in load.rejected.collect()) == [
        "Project with name 'churn' already exists.", "Unknown problem type.", "name has an invalid length.",
    ]
    project = monitor.projects().first()
    assert (project["name"], project["metric_priority"], project["target_column"]) == ("churn", "f1", "churn")
    models = spark.createDataFrame(
        [(project["id"], "forest", "1", "Random Forest", "spark"), (5, "forest", "1", "Random Forest", "spark")],
        "project_id long, name string, version string, algorithm string, framework string",
    )
    load = monitor.register_model_versions(models, at(2))
    assert [r["error"] for r in load.rejected.collect()] == ["Project with ID 5 was not found."]
    again = monitor.register_model_versions(models.limit(1), at(3)).rejected.first()["error"]
    assert again == f"Model 'forest' version '1' already exists in project {project['id']}."
    model = monitor.models(project["id"]).first()
    assert model["status"] == "registered"

    # Train, predict, write the log, load it: the log of one model is the input of its checks.
    rows = [(20 + i % 40, "a" if i % 3 else "b", int(i % 40 > 19)) for i in range(400)]
    data = spark.createDataFrame(rows, "age int, plan string, churn int")
    split = training.stratified_split(data, "churn")
    fitted = training.train_forest(split.where("NOT is_test").drop("is_test"), "churn", trees=5)
    predictions = fitted.predict(split.where("is_test").drop("is_test"))
    metrics = training.evaluate(predictions).first()
    assert (metrics["sample_count"], metrics["accuracy"], metrics["roc_auc"]) == (120, 1.0, 1.0)
    log = str(tmp_path / "log")
    training.write_log(training.prediction_log(predictions, at(4)).coalesce(1), log)
    base = write(str(tmp_path), "train.csv", "age,plan,churn\n" + "".join(f"{a},{p},{c}\n" for a, p, c in rows))
    loaded = ingest.ingest_datasets(
        store,
        spark.createDataFrame([(base, project["id"], "training", "v1")], "path string, project_id long, dataset_type string, version string"),
        at(5),
        base,
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(log).select("path")
    batch = ingest.ingest_predictions(
        store, files.select("path", F.lit(project["id"]).alias("project_id"), F.lit(model["id"]).alias("model_version_id")), at(6), log
    ).accepted.first()
    assert (batch["row_count"], batch["is_labeled"]) == (120, True)
    assert monitor.batch_predictions(batch["id"]).count() == 120
    dataset = loaded.accepted.first()
    assert monitor.dataset_profile(dataset["id"]).first()["column_types"]["plan"] == "object"
    assert {r["class"]: r["n"] for r in monitor.dataset_classes(dataset["id"]).collect()} == {"0": 200, "1": 200}
    kept = store.read("raw_files").collect()
    assert {r["file_path"] for r in kept} == {batch["file_path"], dataset["file_path"]}
    assert {r["content_hash"] for r in kept} == {batch["content_hash"], dataset["content_hash"]}

    requests = spark.createDataFrame(
        [(1, project["id"], model["id"], dataset["id"], batch["id"]), (2, project["id"], model["id"], dataset["id"], 0)],
        "check_id long, project_id long, model_version_id long, baseline_dataset_id long, prediction_batch_id long",
    )
    with pytest.raises(NotFound, match="No health check exists"):
        monitor.latest_health(project["id"])
    queue_jobs(store, requests, at(7))
    assert {r["status"] for r in monitor.jobs().collect()} == {"queued"}
    run_queued(store, at(8))
    assert run_queued(store, at(9)).count() == 0
    assert listing_total(monitor.jobs(1)).first()["total"] == 1
    assert monitor.job(1).first()["status"] == "completed"
    failed = monitor.job(2).first()
    assert (failed["status"], failed["error_message"]) == ("failed", "Prediction batch with ID 0 was not found.")
    health = monitor.latest_health(project["id"]).first()
    assert health["id"] == 1 and health["metrics"]["roc_auc"] == 1.0
    assert monitor.report(1).first()["risk_level"] in ("low", "medium", "high")
    board = monitor.dashboard(project["id"]).first()
    assert [board[c] for c in ("models", "datasets", "prediction_batches", "health_checks")] == [1, 1, 1, 1]
    assert board["latest_health"]["health_check_id"] == 1
    assert [j["id"] for j in board["recent_jobs"]] == [2, 1]
    with pytest.raises(ValueError):
        monitor.jobs(501)

    monitor.delete_model_version(model["id"], at(10))
    counts = {t: store.read(t).count() for t in ("projects", "model_versions", "datasets", "prediction_batches", "predictions", "health_checks", "diagnosis_reports")}
    assert counts == {"projects": 1, "model_versions": 0, "datasets": 1, "prediction_batches": 0, "predictions": 0, "health_checks": 0, "diagnosis_reports": 0}
    monitor.delete_project(project["id"], at(11))
    assert store.read("dataset_rows").isEmpty() and store.read("job_events").isEmpty()
    with pytest.raises(NotFound, match="was not found"):
        monitor.project(project["id"])
    assert monitor.register_projects(projects.limit(1), at(12)).accepted.count() == 1
    assert monitor.projects().count() == 1
