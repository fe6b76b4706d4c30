"""The store under deletions, repeated runs, and loads and runs started together."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tests.test_tables import prepared, stamp, store, write  # noqa: F401
from tidewatch.plans import ingest
from tidewatch.plans.bulk import claim, give_back, queue_jobs, run_and_store, run_queued
from tidewatch.sources import tables
from tidewatch.sources.tables import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _filled(spark, root):
    made = Store(spark, str(root))
    made.append("projects", spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string"))
    made.append("prediction_batches", spark.createDataFrame([(10, 1, 5), (11, 2, 5), (12, 2, 6)], "id long, project_id long, load_id long"))
    rows = [(p, load, b, i) for p, load, b in ((1, 5, 10), (2, 5, 11), (2, 6, 12)) for i in range(3)]
    made.replace_partitions("predictions", spark.createDataFrame(rows, "project_id long, load_id long, batch_id long, row_id long"))
    return made


def test_compaction_rewrites_only_folders_with_deleted_rows(spark, tmp_path):
    made = _filled(spark, tmp_path / "store")
    folder = tmp_path / "store" / "predictions"
    before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    made.delete("prediction_batches", spark.createDataFrame([(11,)], "id long"), stamp())
    assert "LeftAnti" in plan(made.read("predictions"))
    made.compact()
    assert "LeftAnti" not in plan(made.read("predictions")) and made.read("deletions").count() == 0
    assert sorted(r["batch_id"] for r in made.read("predictions").collect()) == [10] * 3 + [12] * 3
    assert sorted(r["id"] for r in made.read("prediction_batches").collect()) == [10, 12]
    after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
    assert after == {p: t for p, t in before.items() if "project_id=2/load_id=5" not in str(p)}
    made.compact()  # nothing to do
    assert made.read("projects").count() == 2


def test_compaction_brings_no_folder_to_one_task(spark, tmp_path, monkeypatch):
    made = _filled(spark, tmp_path / "store")
    reports = spark.range(1000).select("id", (F.col("id") % 4).alias("health_check_id"), F.lit(None).cast("long").alias("run_id"))
    made.replace_partitions("diagnosis_reports", reports)
    made.delete("diagnosis_reports", spark.range(3), stamp())
    plans = []
    real = tables.cut_lineage
    monkeypatch.setattr(tables, "cut_lineage", lambda df: plans.append((df.columns, plan(df))) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made.compact()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = [text for columns, text in plans if "health_check_id" in columns]
    assert kept and all("SortMergeJoin [coalesce(run_id" not in text for text in kept)
    assert made.read("diagnosis_reports").count() == 997


def test_compaction_that_died_is_repeated(spark, tmp_path, monkeypatch):
    made = _filled(spark, tmp_path / "store")
    made.delete("projects", spark.createDataFrame([(2,)], "id long"), stamp())
    calm, seen = Store._compact, []

    def dies(self, table, rows, marks):
        seen.append(table)
        if table == "predictions":
            raise RuntimeError("gone")
        calm(self, table, rows, marks)

    with monkeypatch.context() as patch:
        patch.setattr(Store, "_compact", dies)
        try:
            made.compact()
        except RuntimeError:
            pass
    assert "predictions" in seen and {r["batch_id"] for r in made.read("predictions").collect()} == {10}
    made.compact()
    assert {r["batch_id"] for r in made.read("predictions").collect()} == {10} and made.read("deletions").count() == 0


def test_a_run_reads_no_other_runs_files(spark, store, tmp_path, monkeypatch):  # noqa: F811
    requests = prepared(spark, store, tmp_path, checks=(1, 2))
    run_and_store(store, requests.where("check_id = 1"), stamp())
    asked = []
    calm = Store.of_runs
    monkeypatch.setattr(Store, "of_runs", lambda self, table, runs: asked.append((table, runs)) or calm(self, table, runs))
    run_and_store(store, requests.where("check_id = 2"), stamp())
    assert asked and all(runs == [] for _, runs in asked)
    checks = store.read("health_checks")
    assert sorted(r["id"] for r in checks.collect()) == [1, 2] and checks.select("run_id").distinct().count() == 2


def test_two_runs_started_together_share_the_jobs(spark, store, tmp_path):  # noqa: F811
    requests = prepared(spark, store, tmp_path, checks=range(1, 7))
    queue_jobs(store, requests, stamp())
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(run_queued, store, stamp()) for _ in range(2)]
        outcomes = [r.result().collect() for r in runs]
    assert sorted(r["check_id"] for rows in outcomes for r in rows) == list(range(1, 7))
    for table, key in (("health_checks", "id"), ("diagnosis_reports", "id")):
        assert sorted(r[key] for r in store.read(table).collect()) == list(range(1, 7))
    ends = store.read("job_events").where("status = 'completed'").groupBy("job_id").count().collect()
    assert sorted((r["job_id"], r["count"]) for r in ends) == [(i, 1) for i in range(1, 7)]


def test_leases_end_and_are_given_back(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    ids = lambda df: sorted(r["job_id"] for r in df.collect())
    assert ids(claim(made, jobs, 7, 60.0, 2.0)) == [1, 2]
    assert ids(claim(made, jobs, 8, 60.0, 2.0)) == []
    give_back(made, jobs.where("job_id = 2"), 7)
    assert ids(claim(made, jobs, 8, 60.0, 2.0)) == [2]
    assert ids(claim(made, spark.createDataFrame([(3,)], "job_id long"), 9, -1.0, 2.0)) == []


def test_two_loads_started_together_store_one_copy(spark, store, tmp_path):  # noqa: F811
    base = write(str(tmp_path), "train.csv", "age,churn\n1,0\n2,1\n")
    frame = spark.createDataFrame([(base, 1, "training", "v1")], "path string, project_id long, dataset_type string, version string")
    at = [F.lit(f"2026-07-01 00:00:0{i}").cast("timestamp") for i in (1, 2)]
    with ThreadPoolExecutor(2) as pool:
        loads = [pool.submit(ingest.ingest_datasets, store, frame, t, base) for t in at]
        [load.result() for load in loads]
    listed = store.read("datasets").collect()
    assert len(listed) == 1 and listed[0]["row_count"] == 2
    again = ingest.ingest_datasets(store, frame, at[1], base)
    assert again.accepted.count() == 0 and again.rejected.count() == 1
