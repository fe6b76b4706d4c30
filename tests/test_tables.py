"""Typing, profiles, guards, loading of files and stored health checks."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import profile, registry
from tidewatch.operators.jobs import job_states
from tidewatch.plans import ingest, training
from tidewatch.plans.bulk import queue_jobs, run_and_store, run_queued
from tidewatch.sources import files
from tidewatch.sources.files import list_files, read_rows
from tidewatch.sources.tables import Store
from tidewatch.streaming.prediction_stream import stream_predictions

def stamp():
    return F.lit("2026-07-01 00:00:00").cast("timestamp")


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_missing_tokens(spark):
    values = ["", "NA", "N/A", "null", "None", "nan", "<NA>", "x", " "]
    assert column(spark, values, text.null_if_missing) == [None] * 7 + ["x", " "]


def test_numbers(spark):
    values = ["1", " 0.2 ", "1e-1", "+3.", ".5", "1d", "2f", "nan", "abc", "-inf", "Infinity", None]
    expected = [1.0, 0.2, 0.1, 3.0, 0.5, None, None, None, None, float("-inf"), float("inf"), None]
    assert column(spark, values, text.to_number) == expected


def test_number_text(spark):
    values = [25.0, 0.1, 1e7, 123456789.5, 1e16, 1.5e300, 1e-5, 0.0005, -2.5e8, 1234567.25]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in frame.select(text.number_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_labels_lose_a_zero_fraction(spark):
    assert column(spark, ["1.0", "1", "1.5", "a.0", "-2.00", None], text.label_text) == ["1", "1", "1.5", "a.0", "-2", None]


def types(spark, rows, all_missing="float64"):
    names = [f"c{i}" for i in range(len(rows[0]))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found = profile.column_types(profile.text_cells(frame, names), all_missing=all_missing)
    return {r["feature"]: r["dtype"] for r in found.collect()}


def test_column_types(spark):
    rows = [("1", "1", "1.5", "True", "True", "abc", None, "2026-01-01"), ("2", None, "2", "False", None, "1", None, "2026-01-02")]
    assert list(types(spark, rows)[f"c{i}"] for i in range(8)) == [
        "int64", "float64", "float64", "bool", "object", "object", "float64", "object",
    ]
    assert types(spark, [(None,), (None,)], "object") == {"c0": "object"}


def test_repeated_headers(spark, tmp_path):
    path = write(str(tmp_path), "names.csv", '\ufefff,f,"a,b",,f\n1,2,3,4,5\n')
    (row,) = read_rows(spark, list_files(spark, path), path).collect()
    assert row["cells"] == {"f": "1", "f.1": "2", "a,b": "3", "Unnamed: 3": "4", "f.2": "5"}


def test_profile_of_single_row(spark):
    frame = spark.createDataFrame([("4", "x")], "n string, c string")
    rows = {r["column"]: r for r in profile.profile_cells(profile.text_cells(frame, ["n", "c"])).collect()}
    assert (rows["n"]["mean"], rows["n"]["standard_deviation"]) == (4.0, 0.0)
    assert (rows["c"]["unique"], rows["c"]["most_frequent"], rows["c"]["most_frequent_count"]) == (1, "x", 1)


def test_bool_is_categorical_in_a_profile(spark):
    frame = spark.createDataFrame([("true",), ("true",), ("false",)], "b string")
    row = profile.profile_cells(profile.text_cells(frame, ["b"])).first()
    assert (row["dtype"], row["most_frequent"], row["mean"]) == ("bool", "True", None)


def test_ties_choose_the_smallest_value(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    row = profile.categorical_profile(frame).first()
    assert (row["count"], row["unique"], row["most_frequent"], row["most_frequent_count"]) == (4, 2, "a", 2)


def test_class_counts(spark):
    frame = spark.createDataFrame([("y",), (None,), ("y",)], "t string")
    assert {r["class"]: r["n"] for r in profile.class_counts(frame, "t").collect()} == {"y": 2, "MISSING": 1}


def test_latest_breaks_ties_by_id(spark):
    frame = spark.createDataFrame([(1, 7, "2026-01-01"), (2, 7, "2026-01-01"), (3, 8, "2025-01-01")], "id long, project_id long, created_at string")
    found = {r["project_id"]: r["id"] for r in registry.latest_per_group(frame, ["project_id"]).collect()}
    assert found == {7: 2, 8: 3}


def test_deleting_a_model_takes_its_children(spark):
    tables = {
        "projects": spark.createDataFrame([(1,)], "id long"),
        "model_versions": spark.createDataFrame([(10, 1), (11, 1)], "id long, project_id long"),
        "prediction_batches": spark.createDataFrame([(20, 1, 10), (21, 1, 11)], "id long, project_id long, model_version_id long"),
        "predictions": spark.createDataFrame([(20, 0), (20, 1), (21, 0)], "batch_id long, row_id long"),
        "health_checks": spark.createDataFrame(
            [(30, 1, 10, 5, 20), (31, 1, 11, 5, 21)],
            "id long, project_id long, model_version_id long, baseline_dataset_id long, prediction_batch_id long",
        ),
        "diagnosis_reports": spark.createDataFrame([(40, 30), (41, 31)], "id long, health_check_id long"),
    }
    left = registry.cascade_delete(tables, "model_versions", spark.createDataFrame([(10,)], "id long"))
    counts = {name: frame.count() for name, frame in left.items()}
    assert counts == {
        "projects": 1, "model_versions": 1, "prediction_batches": 1, "predictions": 1, "health_checks": 1, "diagnosis_reports": 1,
    }
    assert left["diagnosis_reports"].first()["id"] == 41


# --- files --------------------------------------------------------------------------------

LOG = """timestamp,age,contract,true_label,predicted_label,confidence
2026-07-01T09:00:00Z,25,"Month, to month",1,1,0.91
2026-07-01T10:00:00Z,43,One year,0,0,0.88
2026-07-01T11:00:00Z,NA,One year,,1,
"""


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.append(
        "projects",
        spark.createDataFrame([(1, "churn", "1"), (2, "churn", None)], "id long, target_column string, positive_class string"),
    )
    made.append("model_versions", spark.createDataFrame([(10, 1), (20, 2)], "id long, project_id long"))
    return made


def write(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as handle:
        handle.write(content)
    return path


def test_refused_logs(spark, store, tmp_path):
    folder = str(tmp_path / "logs")
    uploads = {
        write(folder, "good.csv", LOG): (1, 10, None),
        write(folder, "same.csv", LOG): (1, 10, ingest.KNOWN_LOG),
        write(folder, "foreign.csv", LOG + "\n"): (1, 20, "Model version 20 does not belong to project 1."),
        write(folder, "noproject.csv", LOG): (9, 10, "Project with ID 9 was not found."),
        write(folder, "nomodel.csv", LOG): (1, 99, "Model version with ID 99 was not found."),
        write(folder, "log.txt", LOG): (1, 10, "Only CSV files are supported."),
        write(folder, "empty.csv", ""): (1, 10, "The uploaded CSV file is empty."),
        write(folder, "blank.csv", "\n\n"): (1, 10, "The uploaded file is not a valid readable CSV."),
        write(folder, "header.csv", "predicted_label,x\n"): (1, 10, "The CSV must contain at least one data row."),
        write(folder, "nolabel.csv", "x,y\n1,2\n"): (1, 10, "Required column 'predicted_label' is missing."),
        write(folder, "nullabel.csv", "x,predicted_label\n1,a\n2,\n"): (1, 10, "The 'predicted_label' column cannot contain missing values."),
        write(folder, "text.csv", "predicted_label,confidence\n1,high\n"): (1, 10, "Confidence values must be numeric."),
        write(folder, "range.csv", "predicted_label,confidence\n1,1.2\n"): (1, 10, "Confidence values must be between 0 and 1."),
        write(folder, "date.csv", "predicted_label,timestamp\n1,not a date\n"): (1, 10, "One or more timestamp values are invalid."),
        write(folder, "wide.csv", "predicted_label,x\n1,2,3\n"): (1, 10, "The uploaded file is not a valid readable CSV."),
        write(folder, "large.csv", "predicted_label\n" + "1\n" * 3000): (1, 10, "The uploaded CSV exceeds the 10 MB size limit."),
    }
    frame = spark.createDataFrame([(p, v[0], v[1]) for p, v in uploads.items()], "path string, project_id long, model_version_id long")
    load = ingest.ingest_predictions(store, frame, stamp(), folder, max_bytes=4000)
    refused = {r["path"]: r["error"] for r in load.rejected.collect()}
    assert refused == {p: v[2] for p, v in uploads.items() if v[2]}
    batch = store.read("prediction_batches").collect()
    assert len(batch) == 1 and (batch[0]["row_count"], batch[0]["is_labeled"]) == (3, True)
    assert batch[0]["file_path"] == f"prediction_logs/1/model_10_{batch[0]['content_hash'][:12]}.csv"
    rows = store.read("predictions").orderBy("row_id").collect()
    assert [r["true_label"] for r in rows] == ["1", "0", None]
    assert [r["confidence"] for r in rows] == [0.91, 0.88, None]
    assert rows[0]["features"] == {"age": "25", "contract": "Month, to month"}
    assert rows[2]["features"]["age"] is None
    again = ingest.ingest_predictions(store, frame.limit(1), stamp(), folder)
    assert again.accepted.count() == 0 and store.read("predictions").count() == 3


def test_load_dataset(spark, store, tmp_path):
    good = write(str(tmp_path), "train.csv", "age,plan,churn\n30,a,0\n40,b,1\n,b,1\n")
    bad = write(str(tmp_path), "notarget.csv", "age,plan\n30,a\n")
    frame = spark.createDataFrame(
        [(good, 1, "training", "v1"), (bad, 1, "training", "v2"), (good, 1, "other", "v3")],
        "path string, project_id long, dataset_type string, version string",
    )
    load = ingest.ingest_datasets(store, frame, stamp(), str(tmp_path))
    assert sorted(r["error"] for r in load.rejected.collect()) == [
        "Target column 'churn' was not found in the CSV.", "Unknown dataset type.",
    ]
    made = store.read("datasets").first()
    assert (made["row_count"], made["column_count"], made["version"]) == (3, 3, "v1")
    seen = store.read("dataset_profiles").first()
    assert seen["column_types"] == {"age": "float64", "plan": "object", "churn": "int64"}
    assert seen["missing_values"] == {"age": 1, "plan": 0, "churn": 0}
    assert seen["numeric_summary"]["age"]["mean"] == 35.0 and "plan" not in seen["numeric_summary"]
    assert seen["categorical_summary"]["plan"]["most_frequent"] == "b"
    assert {r["class"]: r["n"] for r in store.read("dataset_classes").collect()} == {"0": 1, "1": 2}
    again = ingest.ingest_datasets(store, frame.limit(1), stamp(), good)
    assert again.rejected.first()["error"] == "Dataset type 'training' version 'v1' already exists in project 1."


def test_different_headers_in_one_load(spark, tmp_path):
    paths = [write(str(tmp_path), "a.csv", "x,y\n1,2\n"), write(str(tmp_path), "b.csv", 'y,z\n3,"4\n5"\n')]
    rows = read_rows(spark, list_files(spark, paths), paths).collect()
    assert sorted(sorted(r["cells"].items()) for r in rows) == [[("x", "1"), ("y", "2")], [("y", "3"), ("z", "4\n5")]]


def test_stored_checks(spark, store, tmp_path):
    rows = [f"{20 + i % 30},{'a' if i % 2 else 'b'},{i % 2}" for i in range(60)]
    base = write(str(tmp_path), "train.csv", "age,plan,churn\n" + "\n".join(rows) + "\n")
    logged = [f"{20 + i % 30},,{i % 2},{i % 2},0.{80 + i % 20}" for i in range(50)]
    log = write(str(tmp_path), "log.csv", "age,plan,true_label,predicted_label,confidence\n" + "\n".join(logged) + "\n")
    data = ingest.ingest_datasets(
        store, spark.createDataFrame([(base, 1, "training", "v1")], "path string, project_id long, dataset_type string, version string"), stamp(), base
    ).accepted.first()
    batch = ingest.ingest_predictions(
        store, spark.createDataFrame([(log, 1, 10)], "path string, project_id long, model_version_id long"), stamp(), log
    ).accepted.first()
    requests = spark.createDataFrame(
        [(1, 1, 10, data["id"], batch["id"]), (2, 2, 20, data["id"], batch["id"]), (3, 1, 77, data["id"], batch["id"])],
        "check_id long, project_id long, model_version_id long, baseline_dataset_id long, prediction_batch_id long",
    )
    outcome = {r["check_id"]: r for r in run_and_store(store, requests, stamp()).collect()}
    assert outcome[1]["job_status"] == "completed" and outcome[1]["error_message"] is None
    assert outcome[2]["error_message"] == "The baseline dataset does not belong to the selected project."
    assert outcome[3]["error_message"] == "Model version with ID 77 was not found."
    check = store.read("health_checks").first()
    # The plan is missing throughout: it counts as categorical, drifts fully and halves the quality.
    assert check["drift"]["drifted_features"] == ["plan"] and check["missing_rate"] == 0.5
    assert check["component_scores"]["data_quality_score"] == 50.0
    assert check["metrics"]["accuracy"] == 1.0
    report = store.read("diagnosis_reports").first()
    assert [f["code"] for f in report["findings"]] == ["FEATURE_DRIFT", "MISSING_VALUES"]
    states = {r["job_id"]: r["status"] for r in job_states(store.read("job_events")).collect()}
    assert states == {1: "completed", 2: "failed", 3: "failed"}


def test_split_takes_exact_numbers_of_copies(spark):
    frame = spark.createDataFrame([("a", 1)] * 37 + [("b", i) for i in range(23)], "label string, x int")
    split = training.stratified_split(frame, "label")
    sizes = {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert sizes == {("a", True): 11, ("a", False): 26, ("b", True): 7, ("b", False): 16}


def test_repeated_load_stores_rows_once(spark, store, tmp_path):
    """The batch listing of a first run is lost; the second run overwrites the same folders."""

    class Forgetful(Store):
        def path(self, table):
            return super().path("lost" if table == "prediction_batches" else table)

    log = write(str(tmp_path / "logs"), "log.csv", LOG)
    frame = spark.createDataFrame([(log, 1, 10)], "path string, project_id long, model_version_id long")
    first = ingest.ingest_predictions(Forgetful(spark, store.root), frame, stamp(), log).accepted.first()
    second = ingest.ingest_predictions(store, frame, stamp(), log).accepted.first()
    assert (first["id"], first["load_id"]) == (second["id"], second["load_id"])
    assert store.read("predictions").count() == 3


def test_one_parse_whatever_the_headers(spark, tmp_path, monkeypatch):
    scans = []
    for most in (1, 5):
        folder = str(tmp_path / str(most))
        for i in range(most):
            write(folder, f"{i}.csv", ",".join(f"c{j}" for j in range(i + 1)) + "\n" + ",".join("1" * (i + 1)) + "\n")
        manifest, plans, cut = list_files(spark, folder), [], files.cut_lineage

        def watched(df, plans=plans, cut=cut):
            plans.append(df._jdf.queryExecution().toString())
            return cut(df)

        with monkeypatch.context() as patch:
            patch.setattr(files, "cut_lineage", watched)
            rows = read_rows(spark, manifest, folder)
        assert sorted(len(r["cells"]) for r in rows.collect()) == list(range(1, most + 1))
        scans.append([p.split("== Physical Plan ==")[1].count("FileScan") for p in plans])
    assert scans[0] == scans[1] and len(scans[0]) == 1


def test_no_paths_on_the_driver():
    for module in (files, ingest):
        with open(module.__file__, encoding="utf-8") as source:
            assert ".collect()" not in source.read()


class Dies(Store):
    """Ends like a killed process at one write, once."""

    at, error = None, KeyboardInterrupt

    def _may_die(self, table, rows):
        if Dies.at and table == Dies.at[0] and (Dies.at[1] is None or Dies.at[1] in rows.columns):
            Dies.at = None
            raise self.error("gone")

    def append(self, table, rows):
        self._may_die(table, rows)
        super().append(table, rows)

    def replace_partitions(self, table, rows):
        self._may_die(table, rows)
        super().replace_partitions(table, rows)


class Breaks(Dies):
    error = RuntimeError


def prepared(spark, store, tmp_path, checks=(1, 2)):
    rows = [f"{20 + i % 30},{'a' if i % 2 else 'b'},{i % 2}" for i in range(60)]
    base = write(str(tmp_path / "base"), "train.csv", "age,plan,churn\n" + "\n".join(rows) + "\n")
    log = write(str(tmp_path / "log"), "log.csv", "age,plan,true_label,predicted_label,confidence\n" + "40,a,1,1,0.9\n30,b,0,0,0.8\n" * 20)
    data = ingest.ingest_datasets(
        store, spark.createDataFrame([(base, 1, "training", "v1")], "path string, project_id long, dataset_type string, version string"), stamp(), base
    ).accepted.first()
    batch = ingest.ingest_predictions(
        store, spark.createDataFrame([(log, 1, 10)], "path string, project_id long, model_version_id long"), stamp(), log
    ).accepted.first()
    return spark.createDataFrame(
        [(c, 1, 10, data["id"], batch["id"]) for c in checks],
        "check_id long, project_id long, model_version_id long, baseline_dataset_id long, prediction_batch_id long",
    )


@pytest.mark.parametrize("point", [("check_classes", None), ("diagnosis_reports", None), ("job_events", "result")])
def test_a_run_that_dies_is_taken_up(spark, store, tmp_path, point):
    requests, fragile = prepared(spark, store, tmp_path), Dies(spark, store.root)
    queue_jobs(store, requests, stamp())
    Dies.at = point
    with pytest.raises(KeyboardInterrupt):
        run_queued(fragile, stamp())
    assert {r["status"] for r in job_states(store.read("job_events")).collect()} == {"running"}
    run_queued(fragile, stamp())
    assert {(r["job_id"], r["status"]) for r in job_states(store.read("job_events")).collect()} == {(1, "completed"), (2, "completed")}
    for table, key in (("health_checks", "id"), ("diagnosis_reports", "id")):
        assert sorted(r[key] for r in store.read(table).collect()) == [1, 2]
    assert store.read("check_features").groupBy("health_check_id", "feature").count().where("count > 1").count() == 0
    assert store.read("check_features").count() == 4 and store.read("check_classes").count() == 4
    queue_jobs(store, requests, stamp())
    assert run_queued(store, stamp()).count() == 0


def test_a_run_that_fails_marks_its_jobs(spark, store, tmp_path):
    requests = prepared(spark, store, tmp_path)
    unknown = requests.limit(1).selectExpr("9 AS check_id", "77 AS project_id", "model_version_id", "baseline_dataset_id", "prediction_batch_id")
    refused = queue_jobs(store, requests.union(unknown), stamp()).collect()
    assert [(r["check_id"], r["error"]) for r in refused] == [(9, "Project with ID 77 was not found.")]
    Breaks.at = Dies.at = ("health_checks", None)
    with pytest.raises(RuntimeError, match="gone"):
        run_queued(Breaks(spark, store.root), stamp())
    states = job_states(store.read("job_events")).collect()
    assert {(r["job_id"], r["status"], r["error_message"]) for r in states} == {(1, "failed", "RuntimeError: gone"), (2, "failed", "RuntimeError: gone")}


def test_a_stream_that_dies_loses_no_check(spark, store, tmp_path):
    requests = prepared(spark, store, tmp_path, (1,)).first()
    folder = str(tmp_path / "arriving")
    for i in range(3):
        write(folder, f"{i}.csv", f"age,plan,true_label,predicted_label,confidence\n{30 + i},a,1,1,0.9\n40,b,0,0,0.8\n")
    failures = [True]

    def asked(batches):
        if failures.pop() if failures else False:
            raise RuntimeError("gone between loading and checking")
        return batches.select(
            F.col("id").alias("check_id"), "project_id", "model_version_id",
            F.lit(requests["baseline_dataset_id"]).alias("baseline_dataset_id"), F.col("id").alias("prediction_batch_id"),
        )

    def start():
        routed = lambda paths: paths.withColumns({"project_id": F.lit(1), "model_version_id": F.lit(10)})
        stream_predictions(store, folder, str(tmp_path / "progress"), routed, asked, stamp).awaitTermination()

    with pytest.raises(Exception, match="gone between"):
        start()
    assert store.read("prediction_batches").count() == 4 and store.read("health_checks").count() == 0
    start()
    assert store.read("health_checks").count() == 3 and store.read("prediction_batches").count() == 4
