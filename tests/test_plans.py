"""Physical plans: pruning, single scans, no sort before the first aggregation."""

import re

from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.frequency import frequency_table
from tidewatch.plans.health_check import of_owners
from tidewatch.session import as_small_side
from tidewatch.sources.tables import Store
from workload import table
from workload.proxies import FEATURES, binary_log, split_lineitem

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drift_reads_only_its_columns(spark):
    text = plan(frequency_table(*split_lineitem(spark, SF_DIR, FEATURES[:2])))
    assert text.count("FileScan") == 2
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert {c.split(":")[0] for c in schema.split(",")} == {"l_quantity", "l_extendedprice", "l_shipdate"}
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in text
    assert "SortAggregate" not in text and "Python" not in text


def test_metrics_count_before_the_shuffle(spark):
    text = plan(metrics.label_counts(binary_log(spark, SF_DIR), ["batch_id"]))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_stored_batches_are_pruned_by_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    items = table(spark, SF_DIR, "lineitem")
    rows = items.select(
        F.lit(1).cast("long").alias("project_id"),
        (F.col("l_suppkey") % 4).alias("load_id"),
        (F.col("l_suppkey") % 8).alias("batch_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("l_returnflag").alias("predicted_label"),
        F.col("l_returnflag").alias("true_label"),
        F.col("l_tax").alias("confidence"),
        F.create_map(F.lit("q"), F.col("l_quantity").cast("string")).alias("features"),
        F.lit(None).cast("timestamp").alias("prediction_timestamp"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    store.replace_partitions("predictions", rows)
    owners = as_small_side(spark.createDataFrame([(2, 2), (1, 5)], "load_id long, batch_id long"))
    kept = of_owners(store.read("predictions"), ["load_id", "batch_id"], owners)
    text = plan(kept)
    assert "dynamicpruning" in text and "GreaterThanOrEqual(batch_id,2)" in text
    assert {r[0] for r in kept.select("batch_id").distinct().collect()} == {2, 5}
    assert kept.count() == items.where("l_suppkey % 8 IN (2, 5)").count()


def test_hot_group_is_spread(spark):
    """One feature value holds most rows, one feature most values; no chunk holds most of them."""
    from tidewatch.operators.cumulative import chunked

    values = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("feature"),
        F.col("id").cast("double").alias("num"),
        F.lit(1).cast("long").alias("n"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in chunked(values, ["feature"], ["num"], ["n"]).groupBy("chunk_no").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 8 and max(sizes) < 20_000 / 8 * 2
