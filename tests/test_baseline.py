"""Baselines indexed once: measures against plain counting, sharing, and physical plans."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import baseline
from tidewatch.operators.baseline import BaselineIndex, as_of, baseline_index, number_counts, packed, value_counts, value_types
from tidewatch.plans import health_check
from tidewatch.plans.health_check import run_checks
from tidewatch.plans.ingest import store_index
from tidewatch.sources.tables import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _stored(spark, rng, datasets, batches, rows=400):
    """Baselines and batches with numbers, constants, gaps, infinities, words and mixed types."""

    def features(shift):
        return {
            "price": f"{rng.gauss(shift, 1):.2f}",
            "count": str(rng.randrange(6 + int(shift))),
            "fixed": "7",
            "gappy": None if rng.random() < 0.3 else str(rng.randrange(50)),
            "word": rng.choice("abcd" if shift < 1 else "abxy"),
            "mixed": rng.choice(("1", "2.0", "n")) if shift >= 1 else rng.choice(("1", "2.0")),
            "wide": rng.choice(("inf", "-inf", "1e3", "0")),
            "empty": None,
        }

    base = [(d, features(0)) for d in datasets for _ in range(rows)]
    logs = [(b, rng.choice("01"), rng.choice("01"), rng.random(), features(b % 3)) for b in batches for _ in range(rows // 2)]
    return (
        spark.createDataFrame(base, "dataset_id long, features map<string,string>"),
        spark.createDataFrame(logs, "batch_id long, true_label string, predicted_label string, confidence double, features map<string,string>"),
        base,
        logs,
    )


def _registries(spark, datasets, batches):
    return {
        "projects": spark.createDataFrame([(1, None, None)], "id long, target_column string, positive_class string"),
        "model_versions": spark.createDataFrame([(5, 1)], "id long, project_id long"),
        "datasets": spark.createDataFrame([(d, 1) for d in datasets], "id long, project_id long"),
        "prediction_batches": spark.createDataFrame([(b, 1, 5) for b in batches], "id long, project_id long, model_version_id long"),
    }


def _requests(spark, pairs):
    rows = [(100 * d + b, 1, 5, d, b) for d, b in pairs]
    return spark.createDataFrame(rows, "check_id long, project_id long, model_version_id long, baseline_dataset_id long, prediction_batch_id long")


def _expected(ref, cur):
    """KS and PSI of two lists of numbers, straight from the definitions."""
    ref, cur = np.sort(np.array(ref, dtype=float)), np.sort(np.array(cur, dtype=float))
    points = np.concatenate([ref, cur])
    gap = np.abs(np.searchsorted(ref, points, side="right") / len(ref) - np.searchsorted(cur, points, side="right") / len(cur)).max()
    edges = []
    for j in range(11):
        place = (len(ref) - 1) * (j * 0.1 if j < 10 else 1.0)
        a, b = ref[math.floor(place)], ref[math.ceil(place)]
        value = a if a == b else a + (b - a) * (place - math.floor(place))
        if value not in edges:
            edges.append(value)
    if len(edges) == 1:
        inside = np.abs(cur - edges[0]) <= 0.5
        return gap, (None if not inside.any() else 0.0)
    total = 0.0
    for i in range(len(edges) - 1):
        low = edges[i] if i else -math.inf
        high = edges[i + 1] if i < len(edges) - 2 else math.inf
        last = i == len(edges) - 2
        share = [max(((v >= low) & ((v < high) | last)).sum() / len(v), 1e-6) for v in (ref, cur)]
        total += (share[1] - share[0]) * math.log(share[1] / share[0])
    return gap, total


@pytest.mark.parametrize("size", [4096, 7])
def test_measures_against_plain_counting(spark, monkeypatch, size):
    monkeypatch.setattr(baseline, "SLICE", size)
    datasets, batches = [20, 21], [1, 2, 3]
    base_df, logs_df, base, logs = _stored(spark, random.Random(size), datasets, batches)
    pairs = [(20, 1), (20, 2), (20, 3), (21, 1)]
    run = run_checks(_requests(spark, pairs), **_registries(spark, datasets, batches), baseline_rows=base_df, predictions=logs_df)
    assert [r["error_message"] for r in run.results.collect()] == [None] * 4
    found = {(r["check_id"], r["feature"]): r for r in run.features.collect()}
    assert len(found) == 4 * 8
    for d, b in pairs:
        for name in ("price", "count", "fixed", "gappy"):
            ref = [float(f[name]) for x, f in base if x == d and f[name] is not None]
            cur = [float(r[4][name]) for r in logs if r[0] == b and r[4][name] is not None]
            row, (gap, psi) = found[100 * d + b, name], _expected(ref, cur)
            assert row["feature_type"] == "numeric"
            assert row["ks_statistic"] == pytest.approx(gap, abs=1e-12)
            assert row["psi"] == (None if psi is None else pytest.approx(psi, abs=1e-9))
        for name in ("word", "empty"):
            ref = [f[name] or "MISSING" for x, f in base if x == d]
            cur = [r[4][name] or "MISSING" for r in logs if r[0] == b]
            tvd = sum(abs(ref.count(c) / len(ref) - cur.count(c) / len(cur)) for c in {*ref, *cur}) / 2
            assert found[100 * d + b, name]["tvd"] == pytest.approx(tvd, abs=1e-12)
        # A feature that one side holds as words is compared by its text.
        ref = ["1.0" if f["mixed"] == "1" else f["mixed"] for x, f in base if x == d]
        if b % 3:
            cur = [r[4]["mixed"] for r in logs if r[0] == b]
            tvd = sum(abs(ref.count(c) / len(ref) - cur.count(c) / len(cur)) for c in {*ref, *cur}) / 2
            assert found[100 * d + b, "mixed"]["tvd"] == pytest.approx(tvd, abs=1e-12)
        gap = found[100 * d + b, "wide"]["ks_statistic"]
        assert gap == pytest.approx(_expected([float(f["wide"]) for x, f in base if x == d], [float(r[4]["wide"]) for r in logs if r[0] == b])[0])
    shares = run.categories.where("feature = 'word'").groupBy("check_id").agg(F.sum("ref_share").alias("r"), F.sum("cur_share").alias("c")).collect()
    assert len(shares) == 4 and all(s["r"] == pytest.approx(1) and s["c"] == pytest.approx(1) for s in shares)


def _index_and_stretches(spark, rng, batches):
    base_df, logs_df, _, _ = _stored(spark, rng, [20], batches)
    values = value_counts(logs_df, "batch_id", baseline.CUR)
    return baseline_index(base_df), packed(number_counts(values, value_types(values)), 16)


def test_baseline_rows_do_not_grow_with_checks(spark, monkeypatch):
    """Eight batches on one baseline: its slices are read as they are, once for all checks."""
    monkeypatch.setattr(baseline, "SLICE", 16)
    read = []
    for batches in (range(1, 2), range(1, 9)):
        index, stretches = _index_and_stretches(spark, random.Random(1), list(batches))
        pairs = [(20, b, f, 10, [0.0, 1.0]) for b in batches for f in ("price", "gappy")]
        shared = spark.createDataFrame(pairs, "dataset_id long, batch_id long, feature string, numbers long, edges array<double>")
        joined = as_of(stretches, shared, index.slices)
        joined.collect()
        # Between the written slices and the last join nothing multiplies them.
        lines = plan(joined).split("== Initial Plan ==")[0].split("\n")
        top = next(i for i, line in enumerate(lines) if "Join" in line)
        side = [line for line in lines[top + 1 :] if line.strip() and not line.lstrip().startswith(":")]
        assert any("Scan" in line for line in side) and not any(w in line for line in side for w in ("Generate", "Join", "Expand"))
        read.append(index.slices.count())
    assert read[0] == read[1]


def test_stretches_cover_the_line_once(spark):
    numbers = spark.range(1000).select(
        F.lit("ref").alias("side"), (F.col("id") % 2).alias("owner"), F.lit("f").alias("feature"), F.col("id").cast("double").alias("num"), F.lit(2).cast("long").alias("n")
    )
    rows = packed(numbers, 64).orderBy("owner", "slice").collect()
    for owner in (0, 1):
        own = [r for r in rows if r["owner"] == owner]
        assert [r["slice"] for r in own] == list(range(len(own))) and max(len(r["nums"]) for r in own) <= 64
        assert [v for r in own for v in r["nums"]] == [float(v) for v in range(owner, 1000, 2)]
        assert [r["before"] for r in own] == [sum(x["rows"] for x in own[:i]) for i in range(len(own))]
        assert {r["all_n"] for r in own} == {1000}
        assert [r["next_low"] for r in own] == [*[r["low"] for r in own[1:]], None]


def test_empty_sides(spark):
    index = baseline_index(spark.createDataFrame([], "dataset_id long, features map<string,string>"))
    assert isinstance(index, BaselineIndex) and all(df.count() == 0 for df in index.tables().values())


def test_stored_slices_are_not_moved(spark, tmp_path, monkeypatch):
    """The stored index gives the same join; its slices are read in buckets, without an exchange."""
    monkeypatch.setattr(baseline, "SLICE", 16)
    index, stretches = _index_and_stretches(spark, random.Random(2), [1, 2])
    store = Store(spark, str(tmp_path / "store"))
    store_index(store, index, -7)
    store_index(store, index, -7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = [(20, b, f, 10, [0.0, 1.0]) for b in (1, 2) for f in ("price", "gappy")]
        shared = spark.createDataFrame(pairs, "dataset_id long, batch_id long, feature string, numbers long, edges array<double>")
        kept = store.read_buckets("baseline_slices")
        columns = ["batch_id", "feature", "part", "number", "slice", "slice_before", "slice_nums"]
        joined = as_of(stretches, shared, kept).select(columns)
        lines = plan(joined).split("\n")
        scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "nums" in line]
        assert len(scans) == 1 and "Bucketed: true" in lines[scans[0]]
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        above = []
        for i in range(scans[0], -1, -1):
            if not above or depth[i] < above[-1][0]:
                above.append((depth[i], lines[i]))
            if "SortMergeJoin" in lines[i] and depth[i] < depth[scans[0]]:
                break
        assert not any("Exchange" in line for _, line in above)
        expected = as_of(stretches, shared, index.slices).select(columns)
        key = lambda r: repr(r)
        assert sorted(joined.collect(), key=key) == sorted(expected.collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert store.read("baseline_features").count() == index.features.count()


def test_arrays_reach_python_in_small_batches(spark, monkeypatch):
    # A row of the comparison has four arrays of a slice, so a batch of the usual size takes far more.
    base, logs, _, _ = _stored(spark, random.Random(4), [1], [1])
    seen, name = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    before, judged = spark.conf.get(name), health_check.judged

    def noted(*args):
        seen.append(spark.conf.get(name))
        return judged(*args)

    monkeypatch.setattr(health_check, "judged", noted)
    run = run_checks(_requests(spark, [(1, 1)]), **_registries(spark, [1], [1]), baseline_rows=base, predictions=logs)
    assert run.results.count() == 1
    assert seen == ["8m"] and spark.conf.get(name) == before


def test_groups_of_a_batch_are_found_without_a_row_at_a_time():
    sides, owners, features = ["cur"] * 5 + ["ref"] * 4, [None, None, 1, 1, 2, 2, 2, 3, 3], ["a", "a", "a", "b", "b", "b", "b", "b", None]
    columns = [pa.array(sides), pa.array(owners, pa.int64()), pa.array(features)]
    batch = pa.RecordBatch.from_arrays(columns, names=baseline.GROUP)
    assert baseline._group_bounds(batch) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 7), (7, 8), (8, 9)]
    assert baseline._group_bounds(batch.slice(0, 0)) == [] and baseline._group_bounds(batch.slice(4, 1)) == [(0, 1)]


def test_numbered_groups_give_the_same_stretches(spark):
    """Names are left out of the sort and come back with the stretches."""
    cells = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("word")), F.array((F.col("id") % 700).cast("string"), (F.col("id") / 8).cast("string"), F.lit("x")))
    values = value_counts(spark.range(3000).select((F.col("id") % 3).alias("dataset_id"), cells.alias("features")), "dataset_id", baseline.REF)
    types = value_types(values).localCheckpoint()
    shown = ["side", "owner", "feature", "slice", "before", "all_n", "low", "high", "rows", "nums", "counts", "next_low"]
    groups = baseline.numeric_groups(types)
    assert groups.count() == 6
    numbers = number_counts(values, groups)
    assert numbers.columns == ["group", "num", "n"]

    def joined(stretches):
        """Values in order; where stretches end depends on the tasks' ranges."""
        out = {}
        for r in stretches.select(*shown).orderBy("side", "owner", "feature", "slice").collect():
            out.setdefault((r["side"], r["owner"], r["feature"], r["all_n"]), []).extend(zip(r["nums"], r["counts"]))
        return out

    found = joined(packed(numbers, 64, groups))
    assert found == joined(packed(number_counts(values, types), 64)) and len(found) == 6
