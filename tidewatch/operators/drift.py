"""Feature drift between a reference and a current table, for any number of groups at once.

Everything follows from one frequency table, which is scanned, counted, sorted and written
once: Kolmogorov-Smirnov and the quantile edges from its running totals, the population
stability index (PSI) from its counts per bin, total variation distance from its shares.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.statistics import ks_p_value
from tidewatch.operators.cumulative import join_on_groups, running_totals
from tidewatch.operators.frequency import CATEGORICAL, NUMERIC, frequency_table
from tidewatch.session import as_small_side, cut_lineage

# The floor of a bin's share and the number of quantile bins.
SHARE_FLOOR = 1e-6
DEFAULT_BINS = 10

# Messages of features without values on one side.
NO_NUMBERS = "Reference and current values must contain numeric data."
NO_CATEGORIES = "Reference and current categories cannot be empty."


@dataclass(frozen=True)
class DriftThresholds:
    """Fixed default values of the four tunable limits and the constant critical distance."""

    psi_warning: float = 0.10
    psi_critical: float = 0.25
    ks_p_value: float = 0.05
    categorical: float = 0.10
    categorical_critical: float = 0.25


def numeric_totals(freq: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The numbers of the frequency table with running and group totals of both sides.

    Categories need no order, so they take no part in the sort.
    """
    numbers = freq.where("txt IS NULL").drop("txt")
    return running_totals(numbers, [*keys, "feature"], ["num"], ["ref_n", "cur_n"], not keys)


def category_totals(freq: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The categories of the frequency table with the totals of both sides of their feature."""
    words = freq.where("txt IS NOT NULL").drop("num")
    groups = [*keys, "feature"]
    whole = words.groupBy(*groups).agg(F.sum("ref_n").alias("all_ref_n"), F.sum("cur_n").alias("all_cur_n"))
    return join_on_groups(words, as_small_side(whole, not keys), groups)


def ks_statistic(totals: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Largest gap between the two empirical distribution functions, per numeric feature."""
    gap = F.abs(F.try_divide("cum_ref_n", "all_ref_n") - F.try_divide("cum_cur_n", "all_cur_n"))
    return (
        totals.groupBy(*keys, "feature")
        .agg(
            F.max(gap).alias("ks_statistic"),
            F.max("all_ref_n").alias("ref_n"),
            F.max("all_cur_n").alias("cur_n"),
        )
    )


def quantile_positions(bins: int = DEFAULT_BINS) -> list[float]:
    """Levels of the quantiles that part a reference into bins."""
    return [j * (1.0 / bins) for j in range(bins)] + [1.0]


def interpolated_edges(ranked: DataFrame, groups: list[str], bins: int = DEFAULT_BINS) -> DataFrame:
    """Distinct quantiles between the values ``below`` and ``above`` each position of ``all_ref_n`` rows."""
    positions = ", ".join(f"(all_ref_n - 1) * {level!r}D" for level in quantile_positions(bins))
    interpolated = f"""
        transform(array({positions}), (p, j) ->
          CASE WHEN above[j] = below[j] THEN below[j]
               WHEN p - floor(p) < 0.5D THEN below[j] + (above[j] - below[j]) * (p - floor(p))
               ELSE above[j] - (above[j] - below[j]) * (1D - (p - floor(p))) END)
    """
    return ranked.select(*groups, F.expr(f"array_distinct({interpolated})").alias("edges"))


def quantile_edges(totals: DataFrame, keys: list[str] = (), bins: int = DEFAULT_BINS) -> DataFrame:
    """Distinct linearly interpolated quantiles of the reference, per numeric feature.

    A quantile lies between the values at two ranks; a row of the running totals covers the
    ranks from ``cum - n`` to ``cum - 1``, so one aggregation finds all of them.
    """
    positions = [f"(all_ref_n - 1) * {level!r}D" for level in quantile_positions(bins)]

    def value_at(rank: str) -> str:
        return f"max(CASE WHEN cum_ref_n - ref_n <= {rank} AND {rank} < cum_ref_n THEN num END)"

    ranked = (
        totals.where("ref_n > 0")
        .groupBy(*keys, "feature")
        .agg(
            F.max("all_ref_n").alias("all_ref_n"),
            F.expr(f"array({', '.join(value_at(f'floor({p})') for p in positions)})").alias("below"),
            F.expr(f"array({', '.join(value_at(f'ceil({p})') for p in positions)})").alias("above"),
        )
    )
    return interpolated_edges(ranked, [*keys, "feature"], bins)


def bin_number(value: str, edges: str) -> Column:
    """1-based bin of a value; NULL when a constant reference leaves it outside its only bin.

    Bins are half-open, the outer ones reach to infinity. A constant reference has the single
    closed bin of half a unit either side.
    """
    below = F.expr(f"size(filter({edges}, e -> e <= {value}))")
    inner = F.least(F.greatest(below, F.lit(1)), F.size(edges) - 1)
    constant = F.when(F.abs(F.col(value) - F.get(F.col(edges), F.lit(0))) <= 0.5, F.lit(1))
    return F.when(F.size(edges) == 1, constant).otherwise(inner)


def histogram(totals: DataFrame, edges: DataFrame, keys: list[str] = (), bins: int = DEFAULT_BINS) -> DataFrame:
    """Reference and current counts per occupied bin of each numeric feature."""
    values = totals.select(*keys, "feature", "num", "ref_n", "cur_n")
    binned = join_on_groups(values, as_small_side(edges, not keys), [*keys, "feature"])
    return (
        binned.withColumn("bin", bin_number("num", "edges"))
        .where("bin IS NOT NULL")
        .groupBy(*keys, "feature", "bin")
        .agg(F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))
    )


def _psi_of(bins: Column, ref_all: Column, cur_all: Column) -> Column:
    """PSI of an array of (bin, ref_n, cur_n); NULL when a side has nothing in any bin."""

    def share(count: Column, whole: Column) -> Column:
        return F.greatest(count / whole, F.lit(SHARE_FLOOR))

    def add(total: Column, b: Column) -> Column:
        ref, cur = share(b["ref_n"], ref_all), share(b["cur_n"], cur_all)
        return total + (cur - ref) * F.log(cur / ref)

    return F.when((ref_all > 0) & (cur_all > 0), F.aggregate(F.sort_array(bins), F.lit(0.0), add))


def bins_psi(ref: Column, cur: Column) -> Column:
    """PSI of two arrays of rows per bin, in the same order of bins."""
    bins = F.transform(F.arrays_zip(ref.alias("ref_n"), cur.alias("cur_n")), lambda b, i: F.struct(i.alias("bin"), b["ref_n"].alias("ref_n"), b["cur_n"].alias("cur_n")))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda whole, n: whole + n)

    return _psi_of(bins, total(ref), total(cur))


def psi(bins: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Population stability index per feature; NULL when no current value falls into a bin."""
    gathered = bins.groupBy(*keys, "feature").agg(
        F.sum("ref_n").alias("ref_all"),
        F.sum("cur_n").alias("cur_all"),
        F.collect_list(F.struct("bin", "ref_n", "cur_n")).alias("bins"),
    )
    return gathered.select(
        *keys, "feature", _psi_of(F.col("bins"), F.col("ref_all"), F.col("cur_all")).alias("psi")
    )


def category_differences(freq: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of every category on both sides and their absolute difference."""
    totals = category_totals(freq, keys)
    ref = F.try_divide("ref_n", "all_ref_n")
    cur = F.try_divide("cur_n", "all_cur_n")
    return totals.select(
        *keys,
        "feature",
        F.col("txt").alias("category"),
        ref.alias("ref_share"),
        cur.alias("cur_share"),
        F.abs(cur - ref).alias("abs_difference"),
    )


def total_variation(freq: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Half the summed share differences, per categorical feature."""
    return (
        category_differences(freq, keys)
        .groupBy(*keys, "feature")
        .agg((F.sum("abs_difference") * F.lit(0.5)).alias("tvd"))
    )


def numeric_severity(psi_value: Column, p_value: Column, limits: DriftThresholds) -> Column:
    return (
        F.when(psi_value >= limits.psi_critical, "critical")
        .when((psi_value >= limits.psi_warning) | (p_value < limits.ks_p_value), "warning")
        .otherwise("stable")
    )


def categorical_severity(distance: Column, limits: DriftThresholds) -> Column:
    return (
        F.when(distance >= limits.categorical_critical, "critical")
        .when(distance >= limits.categorical, "warning")
        .otherwise("stable")
    )


def drift_from_frequencies(
    freq: DataFrame,
    keys: list[str] = (),
    limits: DriftThresholds = DriftThresholds(),
    bins: int = DEFAULT_BINS,
    strict: bool = False,
    method: str = "auto",
) -> DataFrame:
    """One row per (keys, feature): type, measures, severity, or the reason it has none.

    ``missing_n`` is the number of missing current cells, found in the same pass. ``method`` is
    that of ``ks_p_value``.
    """
    keys = list(keys)
    per_feature = [*keys, "feature"]
    freq = cut_lineage(freq)
    totals = numeric_totals(freq, keys)
    edges = as_small_side(quantile_edges(totals, keys, bins), not keys)
    gap = F.abs(F.try_divide("cum_ref_n", "all_ref_n") - F.try_divide("cum_cur_n", "all_cur_n"))
    # One pass over the numbers: everything is summed per bin, then the few bins per feature.
    per_bin = (
        join_on_groups(totals, edges, per_feature, "left")
        .withColumn("bin", F.when(F.col("edges").isNotNull(), bin_number("num", "edges")))
        .groupBy(*per_feature, "bin")
        .agg(
            *[F.sum(c).alias(c) for c in ("gap_n", "ref_n", "cur_n")],
            F.max(gap).alias("gap"),
            F.max("all_ref_n").alias("all_ref_n"),
            F.max("all_cur_n").alias("all_cur_n"),
        )
    )
    inside = F.col("bin").isNotNull()
    numbers = (
        per_bin.groupBy(*per_feature)
        .agg(
            F.sum("gap_n").alias("missing_n"),
            F.max("gap").alias("ks_statistic"),
            F.max("all_ref_n").alias("ref_n"),
            F.max("all_cur_n").alias("cur_n"),
            F.sum(F.when(inside, F.col("ref_n"))).alias("ref_all"),
            F.sum(F.when(inside, F.col("cur_n"))).alias("cur_all"),
            F.collect_list(F.when(inside, F.struct("bin", "ref_n", "cur_n"))).alias("bins"),
        )
        .select(
            *per_feature,
            F.lit(True).alias("numeric"),
            "missing_n",
            "ks_statistic",
            F.lit(None).cast("double").alias("tvd"),
            "ref_n",
            "cur_n",
            _psi_of(F.col("bins"), F.col("ref_all"), F.col("cur_all")).alias("psi"),
        )
    )
    difference = F.abs(F.try_divide("ref_n", "all_ref_n") - F.try_divide("cur_n", "all_cur_n"))
    words = (
        category_totals(freq, keys)
        .groupBy(*per_feature)
        .agg(
            F.lit(False).alias("numeric"),
            F.sum("gap_n").alias("missing_n"),
            F.lit(None).cast("double").alias("ks_statistic"),
            (F.sum(difference) * F.lit(0.5)).alias("tvd"),
            F.max("all_ref_n").alias("ref_n"),
            F.max("all_cur_n").alias("cur_n"),
            F.lit(None).cast("double").alias("psi"),
        )
    )
    return judged(numbers.unionByName(words), per_feature, limits, strict, method)


def judged(
    measured: DataFrame, per_feature: list[str], limits: DriftThresholds = DriftThresholds(), strict: bool = False, method: str = "auto"
) -> DataFrame:
    """Type, measures, severity or error of each feature, from its measures and row counts."""
    numeric = F.col("numeric")
    empty = (F.col("ref_n") == 0) | (F.col("cur_n") == 0)
    # Explicitly spread: the few rows here carry the exact p-values, the only Python work.
    joined = measured.repartition(measured.sparkSession.sparkContext.defaultParallelism, *per_feature)
    p_value = ks_p_value(F.col("ks_statistic"), F.col("ref_n"), F.col("cur_n"), method)
    scored = joined.withColumn("ks_p_value", p_value)
    severity = F.when(numeric, numeric_severity(F.col("psi"), F.col("ks_p_value"), limits)).otherwise(
        categorical_severity(F.col("tvd"), limits)
    )
    message = F.when(empty, F.when(numeric, NO_NUMBERS).otherwise(NO_CATEGORIES))
    if strict:
        severity = F.when(empty, F.raise_error(message)).otherwise(severity)
    return scored.select(
        *per_feature,
        F.when(numeric, NUMERIC).otherwise(CATEGORICAL).alias("feature_type"),
        *[F.when(~empty, F.col(c)).alias(c) for c in ("psi", "ks_statistic", "ks_p_value", "tvd")],
        F.when(~empty, severity).alias("severity") if not strict else severity.alias("severity"),
        message.alias("error"),
        "missing_n",
    )


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    keys: list[str] = (),
    limits: DriftThresholds = DriftThresholds(),
    bins: int = DEFAULT_BINS,
    strict: bool = False,
    method: str = "auto",
) -> DataFrame:
    """Drift of every feature the two typed tables share."""
    return drift_from_frequencies(frequency_table(reference, current, keys), list(keys), limits, bins, strict, method)


def drift_summary(drift: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Feature count, drifted count, rate and names; the names are at most the table's columns."""
    drifted = F.col("severity") != "stable"
    return (
        drift.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("feature_count"),
            F.count_if(drifted).alias("drifted_feature_count"),
            F.array_sort(F.collect_list(F.when(drifted, F.col("feature")))).alias("drifted_features"),
            F.min("error").alias("drift_error"),
            F.sum("missing_n").alias("missing_n"),
        )
        .withColumn(
            "drift_rate",
            F.when(F.col("feature_count") > 0, F.col("drifted_feature_count") / F.col("feature_count")).otherwise(0.0),
        )
    )
