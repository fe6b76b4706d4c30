"""Drift measures on small tables with known results, and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.statistics import exact_two_sample_p, one_sample_p
from tidewatch.operators import drift
from tidewatch.operators.frequency import frequency_table


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


def texts(spark, values, name="c"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def numpy_psi(ref, cur, bins=10):
    ref, cur = np.asarray(ref, float), np.asarray(cur, float)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    r = np.histogram(ref, edges)[0]
    c = np.histogram(cur, edges)[0]
    r, c = np.clip(r / r.sum(), 1e-6, None), np.clip(c / c.sum(), 1e-6, None)
    return float(((c - r) * np.log(c / r)).sum())


def numpy_ks(ref, cur):
    grid = np.unique(np.concatenate([ref, cur]))
    f = np.searchsorted(np.sort(ref), grid, side="right") / len(ref)
    g = np.searchsorted(np.sort(cur), grid, side="right") / len(cur)
    return float(np.abs(f - g).max())


def test_same_values_have_no_drift(spark):
    row = only(drift.feature_drift(numbers(spark, range(1, 101)), numbers(spark, range(1, 101))))
    assert row["psi"] == pytest.approx(0.0, abs=1e-12)
    assert (row["ks_statistic"], row["ks_p_value"], row["severity"]) == (0.0, 1.0, "stable")


def test_shifted_values_are_critical(spark):
    row = only(drift.feature_drift(numbers(spark, range(1, 101)), numbers(spark, range(101, 201))))
    assert row["psi"] == pytest.approx(12.433855885838662, rel=1e-12)
    assert row["ks_statistic"] == 1.0
    assert row["ks_p_value"] == pytest.approx(2.2087607e-59, rel=1e-6)
    assert row["severity"] == "critical"


def test_categorical_distance(spark):
    row = only(drift.feature_drift(texts(spark, ["A"] * 80 + ["B"] * 20), texts(spark, ["A"] * 30 + ["B"] * 70)))
    assert row["tvd"] == pytest.approx(0.5)
    assert (row["feature_type"], row["severity"]) == ("categorical", "critical")


def test_mixed_table(spark):
    ref = spark.createDataFrame([(20 + i, "monthly" if i < 10 else "yearly") for i in range(20)], "age int, contract string")
    cur = spark.createDataFrame([(60 + i, "monthly" if i < 2 else "yearly") for i in range(20)], "age int, contract string")
    rows = {r["feature"]: r for r in drift.feature_drift(ref, cur).collect()}
    assert rows["age"]["psi"] == pytest.approx(12.433855885838662, rel=1e-9)
    assert rows["age"]["ks_p_value"] == pytest.approx(1.4508889e-11, rel=1e-6)
    assert rows["contract"]["tvd"] == pytest.approx(0.4) and rows["contract"]["severity"] == "critical"
    summary = only(drift.drift_summary(drift.feature_drift(ref, cur)))
    assert summary["drifted_features"] == ["age", "contract"] and summary["drift_rate"] == 1.0


@pytest.mark.parametrize("seed", range(4))
def test_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    ref = rng.normal(0, 1, 700) if seed % 2 else rng.integers(0, 12, 700).astype(float)
    cur = rng.normal(0.2, 1.1, 500) if seed % 2 else rng.integers(1, 14, 500).astype(float)
    row = only(drift.feature_drift(numbers(spark, ref), numbers(spark, cur)))
    assert row["psi"] == pytest.approx(numpy_psi(ref, cur), rel=1e-9)
    assert row["ks_statistic"] == pytest.approx(numpy_ks(ref, cur), rel=1e-12)


def test_edges_match_numpy_quantiles(spark):
    rng = np.random.default_rng(7)
    ref = rng.exponential(3, 333)
    totals = drift.numeric_totals(frequency_table(numbers(spark, ref), numbers(spark, ref[:50])))
    edges = only(drift.quantile_edges(totals))["edges"]
    assert edges == list(np.unique(np.quantile(ref, np.linspace(0, 1, 11))))


def test_number_of_bins_is_a_parameter(spark):
    rng = np.random.default_rng(3)
    ref, cur = rng.normal(0, 1, 400), rng.normal(1, 1, 300)
    for bins in (4, 150):
        row = only(drift.feature_drift(numbers(spark, ref), numbers(spark, cur), bins=bins))
        assert row["psi"] == pytest.approx(numpy_psi(ref, cur, bins), rel=1e-9)


def test_many_chunks_give_the_same_result(spark):
    """Runs with the values spread over many range partitions."""
    rng = np.random.default_rng(11)
    ref, cur = rng.normal(0, 1, 3000), rng.normal(0.1, 1, 2000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        totals = drift.numeric_totals(frequency_table(numbers(spark, ref), numbers(spark, cur)))
        assert totals.where("all_ref_n <> 3000 OR all_cur_n <> 2000").count() == 0
        last = totals.orderBy(F.col("num").desc()).first()
        assert (last["cum_ref_n"], last["cum_cur_n"]) == (3000, 2000)
        row = only(drift.feature_drift(numbers(spark, ref), numbers(spark, cur)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert row["psi"] == pytest.approx(numpy_psi(ref, cur), rel=1e-9)
    assert row["ks_statistic"] == pytest.approx(numpy_ks(ref, cur), rel=1e-12)


def test_constant_reference(spark):
    partly = only(drift.feature_drift(numbers(spark, [5, 5, 5, 5]), numbers(spark, [5, 5, 9, 9])))
    assert partly["psi"] == pytest.approx(0.0, abs=1e-12)
    outside = only(drift.feature_drift(numbers(spark, [5, 5, 5, 5]), numbers(spark, [9, 9])))
    assert outside["psi"] is None and outside["ks_statistic"] == 1.0
    assert outside["severity"] == "stable"  # p = 2/15, and an undefined PSI decides nothing


def test_missing_categories_are_a_category(spark):
    row = only(drift.feature_drift(texts(spark, ["a", "b"]), texts(spark, [None, None])))
    assert row["tvd"] == 1.0 and row["severity"] == "critical"


def test_empty_numeric_side_is_an_error_row(spark):
    row = only(drift.feature_drift(numbers(spark, [None, None]), numbers(spark, [1, 2])))
    assert row["error"] == "Reference and current values must contain numeric data."
    assert row["severity"] is None and row["psi"] is None
    with pytest.raises(Exception, match="must contain numeric data"):
        drift.feature_drift(numbers(spark, [None]), numbers(spark, [1, 2]), strict=True).collect()


def test_booleans_are_numbers(spark):
    ref = spark.createDataFrame([(True,)] * 8 + [(False,)] * 2, "flag boolean")
    cur = spark.createDataFrame([(True,)] * 2 + [(False,)] * 8, "flag boolean")
    row = only(drift.feature_drift(ref, cur))
    assert row["feature_type"] == "numeric" and row["ks_statistic"] == pytest.approx(0.6)


def test_text_on_one_side_makes_a_feature_categorical(spark):
    row = only(drift.feature_drift(numbers(spark, [1, 2]), texts(spark, ["1.0", "abc"], "x")))
    assert row["feature_type"] == "categorical" and row["tvd"] == pytest.approx(0.5)


def test_no_shared_features(spark):
    result = drift.feature_drift(numbers(spark, [1], "a"), numbers(spark, [1], "b"))
    summary = only(drift.drift_summary(result))
    assert (summary["feature_count"], summary["drift_rate"]) == (0, 0.0)


def test_groups_do_not_mix(spark):
    ref = spark.createDataFrame([(k, float(i)) for k in ("a", "b") for i in range(50)], "k string, x double")
    cur = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", float(i + 50)) for i in range(50)], "k string, x double")
    rows = {r["k"]: r for r in drift.feature_drift(ref, cur, ["k"]).collect()}
    assert rows["a"]["severity"] == "stable" and rows["b"]["severity"] == "critical"


def test_thresholds_are_parameters(spark):
    ref, cur = texts(spark, ["a"] * 17 + ["b"] * 3), texts(spark, ["a"] * 14 + ["b"] * 6)
    assert only(drift.feature_drift(ref, cur))["severity"] == "warning"
    strictly = drift.DriftThresholds(categorical=0.2)
    assert only(drift.feature_drift(ref, cur, limits=strictly))["severity"] == "stable"


@pytest.mark.parametrize(
    "d, n, m, expected",
    [
        (0.6, 10, 10, 0.0524475524),
        (0.5, 10, 10, 0.1678213427),
        (5 / 12, 7, 12, 0.3357743907),
        (round(0.4 * 260) / 260, 20, 13, 0.1101054643),
        (0.0, 5, 5, 1.0),
        (1.0, 3, 1, 0.5),
    ],
)
def test_exact_p_values(d, n, m, expected):
    assert exact_two_sample_p(d, n, m) == pytest.approx(expected, abs=1e-10)


def test_exact_p_value_by_enumeration():
    from itertools import combinations

    n, m = 5, 4
    places = list(combinations(range(n + m), n))

    def statistic(chosen):
        chosen, f, g, top = set(chosen), 0, 0, 0.0
        for i in range(n + m):
            f, g = f + (i in chosen), g + (i not in chosen)
            top = max(top, abs(f / n - g / m))
        return top

    values = [statistic(p) for p in places]
    for d in sorted(set(values)):
        share = sum(v >= d - 1e-12 for v in values) / len(values)
        assert exact_two_sample_p(d, n, m) == pytest.approx(share, rel=1e-12)


def test_effective_sample_p_values_join_up():
    """The branches of the one-sample tail agree where they meet."""
    for n in (139, 140, 141, 142):
        values = [one_sample_p(n, d) for d in np.linspace(0.02, 0.3, 60)]
        assert all(a >= b - 1e-6 for a, b in zip(values, values[1:]))
    assert one_sample_p(140, 0.1) == pytest.approx(one_sample_p(141, 0.1 * (140 / 141) ** 0.5), rel=2e-3)
    assert one_sample_p(1, 0.75) == pytest.approx(0.5)
