"""Logs written for the loading queries: as many files as their size asks for."""

from pyspark.sql import functions as F

from workload.ingest import _write_csv


def test_number_of_files_does_not_follow_the_number_of_tasks(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 12).select((F.col("id") % 2).alias("kind"), "id")
    _write_csv(rows, str(tmp_path / "logs"), "kind")
    assert len(list((tmp_path / "logs").rglob("*.csv"))) == 2
    read = spark.read.option("header", True).csv(str(tmp_path / "logs"))
    assert read.select("kind", F.col("id").cast("long")).exceptAll(rows.select(F.col("kind").cast("int"), "id")).isEmpty()
    assert read.count() == 3000
