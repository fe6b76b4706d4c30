"""A baseline's distributions, counted and sorted once and used in place by any number of checks.

The numbers of a feature are kept in *slices*: sorted arrays of distinct values with the number of
rows up to each, cut at common bounds so that the slices of a feature cover the whole line. The
current values of a batch are sorted and packed the same way. An as-of join brings each stretch of
current values to the slices it overlaps, where the rows up to and before each value are looked up.

Between two current values the current distribution is flat, so its largest gap to the baseline's
lies at their ends and the Kolmogorov-Smirnov statistic is exact; the population stability index
needs current counts per bin besides the stored ones. Total variation needs the baseline's counts of
the current categories only, since all others differ by their own share. No baseline row is repeated
per check, and a hot value, feature or batch is spread over many stretches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import MISSING_CATEGORY
from tidewatch.functions.typing import FLOAT64, NUMERIC_TYPES, OBJECT, type_counts, type_name, typed_number, typed_text
from tidewatch.operators.drift import DEFAULT_BINS, bins_psi, interpolated_edges, quantile_positions
from tidewatch.operators.frequency import CATEGORICAL, NUMERIC
from tidewatch.session import as_small_side, cut_lineage, small_batches

# Ship these functions with the tasks, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct values of a slice or a stretch. Results do not depend on it.
SLICE = 4096
#: Rows and bytes of a batch that a Python worker holds; a row has up to four arrays of a slice.
BATCH = 10_000, "8m"

@dataclass
class BaselineIndex:
    """What is kept of baselines, by ``dataset_id``.

    ``features`` has a row per feature: its type, cells, missing cells, numbers, quantile ``edges``
    and rows per bin. ``slices`` holds its numbers, ``categories`` its rows per text.
    """

    features: DataFrame
    slices: DataFrame
    categories: DataFrame

    def union(self, other: BaselineIndex) -> BaselineIndex:
        pairs = zip(self.tables().values(), other.tables().values(), strict=True)
        return BaselineIndex(*[a.select(*b.columns).unionByName(b) for a, b in pairs])

    def tables(self) -> dict[str, DataFrame]:
        return {"features": self.features, "slices": self.slices, "categories": self.categories}


REF, CUR = "ref", "cur"
GROUP = ["side", "owner", "feature"]


def value_counts(rows: DataFrame, owner: str, side: str) -> DataFrame:
    """Distinct cell texts of each feature of each owner with their rows, from feature maps."""
    cells = rows.select(F.col(owner).alias("owner"), F.explode("features").alias("feature", "raw"))
    counted = cells.groupBy("owner", "feature", "raw").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(side).alias("side"), "owner", "feature", "raw", "n")


def value_types(values: DataFrame) -> DataFrame:
    """``side, owner, feature, dtype, cells, missing`` from value counts."""
    typed = values.groupBy(*GROUP).agg(*type_counts(F.col("raw"), F.col("n")))
    dtype = F.when(F.col("side") == REF, type_name(FLOAT64)).otherwise(type_name(OBJECT))
    return typed.select(*GROUP, dtype.alias("dtype"), "cells", "missing")


def numeric_groups(types: DataFrame) -> DataFrame:
    """The numeric features of ``types``, each with a number ``group``."""
    kinds = types.where(F.col("dtype").isin(NUMERIC_TYPES)).select(*GROUP, "dtype")
    return as_small_side(kinds.withColumn("group", F.monotonically_increasing_id()))


def number_counts(values: DataFrame, types: DataFrame) -> DataFrame:
    """Rows per number of the numeric features; by ``group`` where ``types`` is of ``numeric_groups``."""
    by = ["group"] if "group" in types.columns else GROUP
    kinds = types if by != GROUP else as_small_side(types.where(F.col("dtype").isin(NUMERIC_TYPES)).select(*GROUP, "dtype"))
    numbers = values.join(kinds, GROUP).select(*by, typed_number(F.col("raw"), F.col("dtype")).alias("num"), "n")
    return numbers.where("num IS NOT NULL").groupBy(*by, "num").agg(F.sum("n").alias("n"))


def category_counts(values: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows per category of the features in ``kinds``, which has their types."""
    texts = values.join(kinds.select(*GROUP, "dtype"), GROUP)
    text = F.coalesce(typed_text(F.col("raw"), F.col("dtype")), F.lit(MISSING_CATEGORY))
    return texts.groupBy("owner", "feature", text.alias("category")).agg(F.sum("n").alias("n"))


# --- packing ----------------------------------------------------------------------------

GROUP_NAMES, GROUP_NUMBER = "side string, owner long, feature string", "group long"
STRETCH = "part long, number long, low double, high double, rows long, nums array<double>, counts array<long>"


def _group_bounds(batch: pa.RecordBatch, by: list[str] = GROUP) -> list[tuple[int, int]]:
    """Where each run of rows of one group begins and ends in a sorted batch."""
    if not batch.num_rows:
        return []
    new = np.zeros(batch.num_rows - 1, dtype=bool)
    for name in by:
        code = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= code[1:] != code[:-1]
    cuts = (np.flatnonzero(new) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, batch.num_rows], strict=True))


def _listed(values: np.ndarray) -> pa.Array:
    """One cell that holds a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _pack(size: int, by: list[str]):
    """Sorted rows (group columns ``by``, num, n) as stretches of at most ``size`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        group, kept, nums, counts = None, [], np.zeros(0), np.zeros(0, dtype=np.int64)

        def row() -> pa.RecordBatch:
            facts = [*group, part, number, nums[0], nums[-1], int(counts.sum())]
            kinds = [*kept, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            arrays = [pa.array([f], k) for f, k in zip(facts, kinds, strict=True)]
            names = [*by, "part", "number", "low", "high", "rows", "nums", "counts"]
            return pa.RecordBatch.from_arrays([*arrays, _listed(nums), _listed(counts)], names=names)

        for batch in batches:
            values, rows = batch.column("num").to_numpy(), batch.column("n").to_numpy()
            kept = [batch.column(c).type for c in by]
            for first, last in _group_bounds(batch, by):
                owner = tuple(batch.column(c)[first].as_py() for c in by)
                if group is not None and group != owner:
                    yield row()
                    number, nums, counts = number + 1, nums[:0], counts[:0]
                group = owner
                nums, counts = np.concatenate([nums, values[first:last]]), np.concatenate([counts, rows[first:last]])
                while len(nums) > size:
                    rest = nums[size:], counts[size:]
                    nums, counts = nums[:size], counts[:size]
                    yield row()
                    number, (nums, counts) = number + 1, rest
        if group is not None:
            yield row()

    return run


def packed(numbers: DataFrame, size: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Numbers as stretches in order, each with the rows of its feature before it and in all.

    Rows are range-partitioned by value first, so one feature's numbers may lie in many tasks. Where
    ``numbers`` tells its groups apart by the ``group`` of ``groups``, their names are not moved and
    sorted with every number, but joined to the stretches.
    """
    by, names = (GROUP, GROUP_NAMES) if groups is None else (["group"], GROUP_NUMBER)
    order = [*by, "num"]
    ranged = numbers.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ranged.mapInArrow(_pack(size or SLICE, by), f"{names}, {STRETCH}")
    if groups is not None:
        rows = rows.join(groups.select(*GROUP, "group"), "group").drop("group")
    rows = cut_lineage(rows)
    # One row per stretch from here on.
    whole = Window.partitionBy(*GROUP)
    before = whole.orderBy("part", "number")
    places = rows.select(
        *GROUP,
        "part",
        "number",
        (F.row_number().over(before) - 1).cast("long").alias("slice"),
        F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(whole).alias("all_n"),
        F.lead("low").over(before).alias("next_low"),
    )
    return cut_lineage(rows.join(as_small_side(places), [*GROUP, "part", "number"]))


# --- the index --------------------------------------------------------------------------


def _cells(column: pa.Array) -> list[np.ndarray]:
    """The arrays in a list column, without copying them."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _ranked(levels: list[float]):
    """Values at the ranks around each quantile, where a slice holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below, above = [], []
            facts = zip(*(batch.column(c).to_pylist() for c in ("before", "all_n")), _cells(batch.column("nums")), _cells(batch.column("counts")), strict=True)
            for before, all_n, nums, counts in facts:
                ends = before + np.cumsum(counts)
                places = [(all_n - 1) * level for level in levels]
                for out, rounded in ((below, np.floor), (above, np.ceil)):
                    ranks = rounded(places)
                    at = np.searchsorted(ends, ranks, side="right")
                    inside = (ranks >= before) & (at < len(ends))
                    out.append([nums[i] if ok else None for i, ok in zip(at, inside, strict=True)])
            doubles = pa.list_(pa.float64())
            columns = [*[batch.column(c) for c in ("owner", "feature", "all_n")], pa.array(below, doubles), pa.array(above, doubles)]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "feature", "all_n", "below", "above"])

    return run


def _binned(nums: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows per bin; the outer bins reach to infinity, a constant has one bin of half a unit either side."""
    out = np.zeros(DEFAULT_BINS, dtype=np.int64)
    if len(edges) == 1:
        with np.errstate(invalid="ignore"):
            out[0] = counts[np.abs(nums - edges[0]) <= 0.5].sum()
        return out
    at = np.clip(np.searchsorted(edges, nums, side="right"), 1, len(edges) - 1) - 1
    np.add.at(out, at, counts)
    return out


def _slice_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins = [_binned(*cells) for cells in zip(*(_cells(batch.column(c)) for c in ("nums", "counts", "edges")), strict=True)]
        columns = [batch.column("owner"), batch.column("feature"), pa.array(bins, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["owner", "feature", "bins"])


def _summed_bins() -> Column:
    return F.array(*[F.sum(F.get("bins", F.lit(i))) for i in range(DEFAULT_BINS)]).alias("bins")


def stretches_of(values: DataFrame, types: DataFrame) -> DataFrame:
    """The numbers among value counts, packed."""
    groups = numeric_groups(types)
    return packed(number_counts(values, groups), groups=groups)


def index_of(values: DataFrame, types: DataFrame, stretches: DataFrame) -> BaselineIndex:
    """The index of the baselines among value counts, types and packed numbers."""
    types, slices = (df.where(F.col("side") == REF) for df in (types, stretches))
    per_feature = ["owner", "feature"]
    levels = quantile_positions(DEFAULT_BINS)
    found = "owner long, feature string, all_n long, below array<double>, above array<double>"
    ranked = slices.select(*per_feature, "before", "all_n", "nums", "counts").mapInArrow(_ranked(levels), found)
    ends = ranked.groupBy(*per_feature).agg(
        F.max("all_n").alias("all_ref_n"),
        *[F.array(*[F.max(F.get(c, F.lit(i))) for i in range(len(levels))]).alias(c) for c in ("below", "above")],
    )
    spark = values.sparkSession
    with small_batches(spark, *BATCH):
        edges = as_small_side(interpolated_edges(ends, [*per_feature, "all_ref_n"], DEFAULT_BINS))
    binned = slices.select(*per_feature, "nums", "counts").join(edges.select(*per_feature, "edges"), per_feature)
    bins = binned.mapInArrow(_slice_bins, "owner long, feature string, bins array<long>").groupBy(*per_feature).agg(_summed_bins())
    features = types.join(edges, per_feature, "left").join(bins, per_feature, "left").select(
        F.col("owner").alias("dataset_id"),
        "feature",
        "dtype",
        "cells",
        "missing",
        F.coalesce("all_ref_n", F.lit(0)).cast("long").alias("numbers"),
        "edges",
        "bins",
    )
    kept = slices.select(
        F.col("owner").alias("dataset_id"),
        "feature",
        "slice",
        # The first slice begins at minus infinity, the last one has no end.
        F.when(F.col("slice") > 0, F.col("low")).alias("low"),
        F.col("next_low").alias("high"),
        "before",
        "nums",
        "counts",
    )
    categories = category_counts(values.where(F.col("side") == REF), types).withColumnRenamed("owner", "dataset_id")
    with small_batches(spark, *BATCH):
        return BaselineIndex(as_small_side(features), kept, categories)


def baseline_index(rows: DataFrame) -> BaselineIndex:
    """Index baselines given as rows ``(dataset_id, features)``."""
    values = cut_lineage(value_counts(rows, "dataset_id", REF))
    types = as_small_side(value_types(values))
    return index_of(values, types, stretches_of(values, types))


# --- measuring --------------------------------------------------------------------------


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Largest gap and rows per bin of the current values of a stretch that lie in a slice."""
    facts = ("before", "all_n", "slice_low", "slice_high", "slice_before", "numbers")
    arrays = ("nums", "counts", "slice_nums", "slice_counts", "edges")
    for batch in batches:
        gaps, bins = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in facts), *(_cells(batch.column(c)) for c in arrays), strict=True)
        for before, all_n, low, high, slice_before, numbers, nums, counts, slice_nums, slice_counts, edges in rows:
            first = 0 if low is None else int(np.searchsorted(nums, low, side="left"))
            last = len(nums) if high is None else int(np.searchsorted(nums, high, side="left"))
            value, held = nums[first:last], counts[first:last]
            upto = before + counts[:first].sum() + np.cumsum(held)
            stored = np.concatenate(([0], np.cumsum(slice_counts))) + slice_before
            gap = None
            for side, current in (("right", upto), ("left", upto - held)):
                if len(value):
                    share = stored[np.searchsorted(slice_nums, value, side=side)] / numbers
                    gap = max(gap or 0.0, float(np.abs(share - current / all_n).max()))
            gaps.append(gap)
            bins.append(_binned(value, held, edges))
        kept = ("dataset_id", "batch_id", "feature", "missing_n", "numbers", "all_n", "ref_bins")
        columns = [*[batch.column(c) for c in kept], pa.array(gaps, pa.float64()), pa.array(bins, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "gap", "bins"])


def _overlaps(stretches: DataFrame, shared: DataFrame, slices: DataFrame) -> DataFrame:
    """The slices each stretch reaches, from the first to the last value, found in one sorted pass.

    Starts of slices and ends of stretches are put in order; an end lies in the slice that started
    last. Only bounds are moved here, one row per slice or stretch.
    """
    keys = ["dataset_id", "batch_id", "feature"]
    place = [*keys, "part", "number"]
    starts = slices.where("low IS NOT NULL").select(
        "dataset_id", F.lit(None).cast("long").alias("batch_id"), "feature", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("number"), F.col("low").alias("value"), "slice"
    )
    reach = stretches.select(F.col("owner").alias("batch_id"), "feature", "part", "number", F.explode(F.array("low", "high")).alias("value"))
    ends = shared.select(*keys).join(reach, ["batch_id", "feature"]).select(*place, "value", F.lit(None).cast("long").alias("slice"))
    upto = Window.partitionBy("dataset_id", "feature").orderBy("value", F.col("slice").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(ends).withColumn("slice", F.coalesce(F.last("slice", True).over(upto), F.lit(0)))
    spans = found.where("part IS NOT NULL").groupBy(*place).agg(F.min("slice").alias("first"), F.max("slice").alias("last"))
    return spans.select(*place, F.explode(F.sequence("first", "last")).alias("slice"))


def as_of(stretches: DataFrame, shared: DataFrame, slices: DataFrame) -> DataFrame:
    """Stretches of current values beside the slices of the baselines they are compared with.

    ``shared`` has a row per (dataset_id, batch_id, feature). Places are met first, by the bounds of
    slices and stretches alone; then each side's arrays are fetched by equality, the slices from
    where they lie.
    """
    keys = ["dataset_id", "batch_id", "feature"]
    met = _overlaps(stretches, shared, slices).join(shared, keys)
    arrays = stretches.select(F.col("owner").alias("batch_id"), "feature", "part", "number", "before", "all_n", "nums", "counts")
    stored = slices.select(
        "dataset_id",
        "feature",
        "slice",
        *[F.col(c).alias(f"slice_{c}") for c in ("low", "high", "before", "nums", "counts")],
    )
    return met.join(arrays, ["batch_id", "feature", "part", "number"]).join(stored, ["dataset_id", "feature", "slice"])


def numeric_measures(stretches: DataFrame, shared: DataFrame, slices: DataFrame) -> DataFrame:
    """KS statistic, PSI and row counts per (dataset_id, batch_id, feature) of numeric features.

    ``stretches`` are the packed current numbers.
    """
    keys = ["dataset_id", "batch_id", "feature"]
    stretches = stretches.where(F.col("side") == CUR)
    wanted = shared.select(*keys, "missing_n", "numbers", "edges", F.col("bins").alias("ref_bins"))
    compared = as_of(stretches, wanted.where("numbers > 0"), slices).mapInArrow(
        _gaps,
        "dataset_id long, batch_id long, feature string, missing_n long, numbers long, all_n long, ref_bins array<long>, "
        "gap double, bins array<long>",
    )
    facts = [F.max(c).alias(c) for c in ("missing_n", "numbers", "all_n", "ref_bins")]
    found = compared.groupBy(*keys).agg(*facts, F.max("gap").alias("gap"), _summed_bins())
    none = F.lit(None)
    empty = wanted.where("numbers = 0").select(
        *keys, "missing_n", "numbers", none.cast("long").alias("all_n"), "ref_bins", none.cast("double").alias("gap"), none.cast("array<bigint>").alias("bins")
    )
    return found.unionByName(empty).select(
        *keys,
        F.lit(True).alias("numeric"),
        "missing_n",
        F.col("gap").alias("ks_statistic"),
        none.cast("double").alias("tvd"),
        F.col("numbers").alias("ref_n"),
        F.coalesce("all_n", F.lit(0)).alias("cur_n"),
        bins_psi(F.col("ref_bins"), F.col("bins")).alias("psi"),
    )


def categorical_measures(current: DataFrame, shared: DataFrame, categories: DataFrame) -> DataFrame:
    """Total variation distance and row counts per (dataset_id, batch_id, feature).

    Half of the sum over current categories of ``|c / C - r / R|``, plus the share of the baseline that
    lies in others. Sums are whole numbers, divided once.
    """
    keys = ["dataset_id", "batch_id", "feature"]
    wide = "decimal(38,0)"
    cells = shared.select(*keys, "missing_n", F.col("cells").cast(wide).alias("ref_all"), F.col("cur_cells").cast(wide).alias("cur_all"))
    rows = current.select(F.col("owner").alias("batch_id"), "feature", "category", F.col("n").alias("cur_n"))
    stored = categories.select("dataset_id", "feature", "category", F.col("n").alias("ref_n"))
    met = rows.join(cells, ["batch_id", "feature"]).join(stored, ["dataset_id", "feature", "category"], "left")
    ref = F.coalesce("ref_n", F.lit(0))
    apart = F.abs(F.col("cur_n") * F.col("ref_all") - ref * F.col("cur_all")).cast(wide)
    found = met.groupBy(*keys).agg(
        F.sum(apart).cast(wide).alias("apart"), F.sum(ref).alias("met"), *[F.max(c).alias(c) for c in ("missing_n", "ref_all", "cur_all")]
    )
    ref_all, cur_all = F.col("ref_all"), F.col("cur_all")
    whole = (F.col("apart") + (cur_all * (ref_all - F.col("met"))).cast(wide)).cast("double")
    return found.select(
        *keys,
        F.lit(False).alias("numeric"),
        "missing_n",
        F.lit(None).cast("double").alias("ks_statistic"),
        F.try_divide(whole, (F.lit(2) * ref_all * cur_all).cast("double")).alias("tvd"),
        ref_all.cast("long").alias("ref_n"),
        cur_all.cast("long").alias("cur_n"),
        F.lit(None).cast("double").alias("psi"),
    )


def shared_features(pairs: DataFrame, features: DataFrame, current_types: DataFrame) -> DataFrame:
    """One row per pair and feature that both sides have, except the target.

    ``pairs`` has dataset_id, batch_id and target_column.
    """
    current = current_types.where(F.col("side") == CUR).select(
        F.col("owner").alias("batch_id"),
        "feature",
        F.col("dtype").alias("cur_dtype"),
        F.col("cells").alias("cur_cells"),
        F.col("missing").alias("missing_n"),
    )
    numeric = F.col("dtype").isin(NUMERIC_TYPES) & F.col("cur_dtype").isin(NUMERIC_TYPES)
    return (
        pairs.join(features.drop("missing"), "dataset_id")
        .where("target_column IS NULL OR feature <> target_column")
        .join(current, ["batch_id", "feature"])
        .withColumn("kind", F.when(numeric, NUMERIC).otherwise(CATEGORICAL))
        .drop("target_column")
    )


def category_shares(current: DataFrame, shared: DataFrame, categories: DataFrame) -> DataFrame:
    """Share of every category of either side, per (dataset_id, batch_id, feature): details to store."""
    keys = ["dataset_id", "batch_id", "feature"]
    pairs = shared.select(*keys, F.col("cells").alias("ref_all"), F.col("cur_cells").alias("cur_all"))
    none = F.lit(0).cast("long")
    stored = pairs.join(categories, ["dataset_id", "feature"]).select(*keys, "ref_all", "cur_all", "category", F.col("n").alias("ref_n"), none.alias("cur_n"))
    rows = current.select(F.col("owner").alias("batch_id"), "feature", "category", "n")
    found = pairs.join(rows, ["batch_id", "feature"]).select(*keys, "ref_all", "cur_all", "category", none.alias("ref_n"), F.col("n").alias("cur_n"))
    both = stored.unionByName(found).groupBy(*keys, "category").agg(*[F.sum(c).alias(c) for c in ("ref_n", "cur_n")], *[F.max(c).alias(c) for c in ("ref_all", "cur_all")])
    ref, cur = F.try_divide("ref_n", "ref_all"), F.try_divide("cur_n", "cur_all")
    return both.select(*keys, "category", ref.alias("ref_share"), cur.alias("cur_share"), F.abs(cur - ref).alias("abs_difference"))
