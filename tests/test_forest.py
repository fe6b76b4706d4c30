import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.forest import bin_bounds, grow_forest
from tidewatch.plans import training


def test_bounds_are_all_values_or_quantiles(spark):
    frame = spark.range(10_000).select(
        (F.col("id") % 3).alias("few"),
        F.when(F.col("id") > 9, F.col("id").cast("double")).alias("many"),
        F.when(F.col("id") < 5, float("nan")).otherwise(2.0).alias("one"),
    )
    few, many, one = bin_bounds(frame, ["few", "many", "one"])
    assert (few, one) == ([1.0, 2.0], [])
    assert len(many) == 31 and np.allclose(np.diff(many), 312, atol=8)


def test_split_is_found_among_counted_rows(spark):
    """Ten codes times two kinds: twenty counted rows, whatever the number of rows."""
    rows = spark.range(40_000).select((F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 3).cast("int").alias("kind"))
    by_code = rows.withColumn("y", (F.col("x") >= 6).cast("int"))
    forest = grow_forest(by_code, ["x", "kind"], "y", [0, 3], 10, [1.0, 1.0], 1, 2, 7)
    assert (forest.column[0, 0], forest.low[0, 0]) == (0, 6)
    assert forest.probability[0, 1:3].tolist() == [[1.0, 0.0], [0.0, 1.0]]
    by_kind = rows.withColumn("y", (F.col("kind") == 1).cast("int"))
    forest = grow_forest(by_kind, ["x", "kind"], "y", [0, 3], 10, [1.0, 3.0], 1, 1, 7)
    assert (forest.column[0, 0], forest.low[0, 0], forest.high[0, 0]) == (1, 1, 1)
    # Classes weigh as told: a third of the rows at three times the weight.
    assert np.allclose(forest.probability[0, 0], [0.4, 0.6], atol=0.02)


def test_bootstrap_draws_each_row_apart(spark):
    """A counted row of n rows is drawn about n times by every tree, never for n times one draw."""
    rows = spark.range(20_000).select(F.lit(0).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    forest = grow_forest(rows, ["x"], "y", [0], 2, [1.0, 1.0], 50, 1, 3)
    shares = forest.probability[:, 0, 0]
    assert 0.45 < shares.min() < shares.max() < 0.55 and len(set(shares)) > 25


def test_missing_numbers_and_unseen_categories(spark):
    rows = spark.range(6_000).select(
        (F.col("id") % 50).cast("double").alias("x"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("c"),
    )
    labeled = rows.withColumn("y", F.when((F.col("x") > 30) | (F.col("c") == "c3"), "yes").otherwise("no"))
    model = training.train_forest(labeled, "y", trees=40)
    assert (model.labels, model.features) == (["no", "yes"], ["x", "c"])
    found = model.predict(labeled)
    assert found.columns == ["x", "c", "true_label", "predicted_label", "confidence"]
    assert found.where("true_label = predicted_label").count() > 5_700
    odd = spark.createDataFrame([(None, "never seen", "no"), (float("nan"), None, "no"), (1.0, None, "no")], labeled.schema)
    assert [r["predicted_label"] for r in model.predict(odd).collect()] == ["yes", "yes", "no"]
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="missing or infinite number in 'x'"):
            training.train_forest(labeled.unionByName(spark.createDataFrame([(bad, "c1", "no")], labeled.schema)), "y", trees=2)
