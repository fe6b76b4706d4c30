"""Registry lookups, guards and deletions over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import REFERENCES


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; pushed down to the table's files."""
    return reduce(lambda d, item: d.where(F.col(item[0]) == F.lit(item[1])), values.items(), df)


def newest_first(df: DataFrame, stamp: str = "created_at", limit: int | None = None, id_column: str = "id") -> DataFrame:
    """Newest rows first, larger id first on ties; with a limit only the top rows are sorted."""
    ordered = df.orderBy(F.col(stamp).desc(), F.col(id_column).desc())
    return ordered if limit is None else ordered.limit(limit)


def oldest_first(df: DataFrame, id_column: str = "id") -> DataFrame:
    return df.orderBy(F.col(id_column).asc())


def listing_total(listing: DataFrame) -> DataFrame:
    """Number of rows of a listing, counted after its limit."""
    return listing.agg(F.count(F.lit(1)).alias("total"))


def latest_per_group(df: DataFrame, group: list[str], stamp: str = "created_at", id_column: str = "id") -> DataFrame:
    """The newest row of each group; each task keeps its own newest first, so a hot group is no hot task."""
    return newest_per_group(df, group, 1, stamp, id_column).drop("rank").select(*group, *[c for c in df.columns if c not in group])


def newest_per_group(
    df: DataFrame, group: list[str], count: int, stamp: str = "created_at", id_column: str = "id"
) -> DataFrame:
    """The newest ``count`` rows of each group with their rank; each task keeps its own top rows first."""
    order = Window.partitionBy(*group).orderBy(F.col(stamp).desc(), F.col(id_column).desc())
    return df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= count)


def orphans(children: DataFrame, parents: DataFrame, foreign_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents, children[foreign_key] == parents[parent_key], "left_anti")


def first_of_each(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One row per identity, the first in ``order``; each task keeps its own firsts before the shuffle."""
    place = Window.partitionBy(*identity).orderBy(*order)
    return df.withColumn("place_no", F.row_number().over(place)).where("place_no = 1").select(*df.columns)


def accept_new(incoming: DataFrame, existing: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Rows to insert: the first of each identity that is not registered yet."""
    return first_of_each(incoming, identity, order).join(existing.select(*identity), identity, "left_anti")


def reject_known(incoming: DataFrame, existing: DataFrame, identity: list[str], id_column: str) -> DataFrame:
    """Rows to refuse: registered already, or not the first of their identity in this load."""
    firsts = incoming.groupBy(*identity).agg(F.min(id_column).alias("first_id"))
    known = existing.select(*identity).distinct().withColumn("is_known", F.lit(True))
    state = firsts.join(known, identity, "left")
    return (
        incoming.join(state, identity)
        .where(F.col("is_known").isNotNull() | (F.col(id_column) != F.col("first_id")))
        .select(*incoming.columns)
    )


def cascade_delete(
    tables: dict[str, DataFrame],
    root: str,
    doomed: DataFrame,
    cascades: dict[str, dict[str, str]] = REFERENCES,
) -> dict[str, DataFrame]:
    """Tables left after deleting ``doomed`` ids (column ``id``) from ``root`` and all that hang on it.

    The ids that disappear are followed downwards (they are the small side of each anti-join);
    surviving rows are never joined to each other.
    """
    gone = {root: doomed.select("id").distinct()}
    left = dict(tables)
    left[root] = tables[root].join(gone[root], "id", "left_anti")
    for name, parents in cascades.items():
        if name not in tables:
            continue
        hits = [
            tables[name].join(gone[p].withColumnRenamed("id", key), key, "left_semi")
            for p, key in parents.items()
            if p in gone
        ]
        if not hits:
            continue
        if "id" in tables[name].columns:
            gone[name] = reduce(DataFrame.union, [h.select("id") for h in hits]).distinct()
        for p, key in parents.items():
            if p in gone:
                left[name] = left[name].join(gone[p].withColumnRenamed("id", key), key, "left_anti")
        left[name] = left[name].select(*tables[name].columns)
    return left


def length_violations(limits: dict[str, tuple[int, int]]) -> Column:
    """First text column whose length lies outside its limits, NULL if all fit."""
    bad = [
        F.when(~F.length(c).between(low, high) | (F.col(c).isNull() & F.lit(low > 0)), c)
        for c, (low, high) in limits.items()
    ]
    return F.coalesce(*bad)
