"""Table profiles, types and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import profile
from workload import query, table

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def numeric_sql(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count({n}) AS count, round(avg({n}), 6) AS mean,
        min({n})::DOUBLE AS minimum, max({n})::DOUBLE AS maximum,
        round(coalesce(stddev_samp({n}), 0), 6) AS standard_deviation FROM {source}"""
        for n in names
    )


def categorical_sql(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"""(SELECT '{n}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
        arg_min(value, (-n, value)) AS most_frequent, max(n) AS most_frequent_count
        FROM (SELECT {n}::VARCHAR AS value, count(*) AS n FROM {source} WHERE {n} IS NOT NULL GROUP BY ALL))"""
        for n in names
    )


def _rounded(df):
    return df.select(
        "column",
        "count",
        F.round("mean", 6).alias("mean"),
        "minimum",
        "maximum",
        F.round("standard_deviation", 6).alias("standard_deviation"),
    )


@query("profile_numeric", numeric_sql("orders", ORDER_NUMBERS))
def profile_numeric(spark, sf_dir):
    return _rounded(profile.numeric_profile(table(spark, sf_dir, "orders").drop("o_orderdate")))


@query("profile_numeric_lineitem", numeric_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def profile_numeric_lineitem(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return _rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), names))


@query(
    "profile_categorical",
    categorical_sql("(SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)", ["status", "o_orderpriority"]),
)
def profile_categorical(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderpriority"
    )
    return profile.categorical_profile(orders)


@query("profile_categorical_documents", categorical_sql("documents", ["text", "lang", "source"]))
def profile_categorical_documents(spark, sf_dir):
    """Whole texts as categories: copies make the most frequent value."""
    return profile.categorical_profile(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


PART_TYPES = {
    "p_partkey": "int64",
    "p_name": "object",
    "p_brand": "object",
    "p_type": "object",
    "p_size": "float64",
    "p_retailprice": "float64",
}


@query(
    "profile_types",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS "column", '{t}' AS dtype,
        count(*) FILTER ({f"nullif({n}, 10)" if n == "p_size" else n} IS NULL) AS missing FROM part"""
        for i, (n, t) in enumerate(PART_TYPES.items())
    ),
)
def profile_types(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("p_size", F.nullif(F.col("p_size"), F.lit(10)))
    return profile.declared_types(parts).select("position", "column", "dtype", "missing")


# A text table as a CSV reader sees it: numbers with gaps, one bad token, flags, dates.
TEXT_COLUMNS = {
    "key": "event_id::VARCHAR",
    "amount": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value::VARCHAR END",
    "mixed": "CASE WHEN event_id = 7 THEN 'abc' ELSE user_id::VARCHAR END",
    "gaps": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id::VARCHAR END",
    "flag": "CASE WHEN value > 20 THEN 'true' ELSE 'false' END",
    "kind": "event_type",
    "blank": "NULL::VARCHAR",
}


def _event_text(spark, sf_dir):
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        key.cast("string").alias("key"),
        F.when(key % 10 != 0, F.col("value").cast("string")).alias("amount"),
        F.when(key == 7, "abc").otherwise(user).alias("mixed"),
        F.when(key % 3 != 0, user).alias("gaps"),
        F.when(F.col("value") > 20, "true").otherwise("false").alias("flag"),
        F.col("event_type").alias("kind"),
        F.lit(None).cast("string").alias("blank"),
    )


EVENT_TEXT = f"text_events AS (SELECT {', '.join(f'{e} AS {n}' for n, e in TEXT_COLUMNS.items())} FROM events)"


@query(
    "infer_types",
    f"""WITH {EVENT_TEXT} """
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS feature, count(*) FILTER ({n} IS NULL) AS missing,
        CASE WHEN count({n}) = 0 THEN 'float64'
          WHEN bool_and({n} IN ('true', 'false')) THEN CASE WHEN count({n}) = count(*) THEN 'bool' ELSE 'object' END
          WHEN bool_and(try_cast({n} AS BIGINT) IS NOT NULL AND NOT contains({n}, '.')) FILTER ({n} IS NOT NULL)
            THEN CASE WHEN count({n}) = count(*) THEN 'int64' ELSE 'float64' END
          WHEN bool_and(try_cast({n} AS DOUBLE) IS NOT NULL) FILTER ({n} IS NOT NULL) THEN 'float64'
          ELSE 'object' END AS dtype FROM text_events"""
        for i, n in enumerate(TEXT_COLUMNS)
    ),
)
def infer_types(spark, sf_dir):
    cells = profile.text_cells(_event_text(spark, sf_dir), list(TEXT_COLUMNS))
    return profile.column_types(cells).select("position", "feature", "missing", "dtype")


@query(
    "profile_text_table",
    f"""WITH {EVENT_TEXT},
    numbers AS ({" UNION ALL ".join(
        f'''SELECT '{n}' AS "column", count({n}) AS count, round(avg({n}::DOUBLE), 6) AS mean,
        min({n}::DOUBLE) AS minimum, max({n}::DOUBLE) AS maximum,
        round(coalesce(stddev_samp({n}::DOUBLE), 0), 6) AS standard_deviation FROM text_events'''
        for n in ("key", "amount", "gaps", "blank"))}),
    words AS ({categorical_sql("text_events", ["mixed", "flag", "kind"])})
    SELECT "column", count, mean, minimum, maximum, standard_deviation, NULL::BIGINT AS "unique",
      NULL::VARCHAR AS most_frequent, NULL::BIGINT AS most_frequent_count FROM numbers
    UNION ALL SELECT "column", count, NULL, NULL, NULL, NULL, "unique",
      CASE "column" WHEN 'flag' THEN upper(most_frequent[1]) || most_frequent[2:] ELSE most_frequent END,
      most_frequent_count FROM words""",
)
def profile_text_table(spark, sf_dir):
    cells = profile.text_cells(_event_text(spark, sf_dir), list(TEXT_COLUMNS))
    rows = profile.profile_cells(cells)
    return _rounded(rows).join(rows.select("column", "unique", "most_frequent", "most_frequent_count"), "column")


@query(
    "schema_hash",
    f"SELECT sha256('{'|'.join(f'{n}:{t}' for n, t in PART_TYPES.items())}') AS schema_hash, count(*) AS parts FROM part",
)
def schema_hash(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("p_size", F.nullif(F.col("p_size"), F.lit(10)))
    hashed = profile.schema_fingerprint(profile.declared_types(parts))
    return hashed.join(F.broadcast(parts.agg(F.count(F.lit(1)).alias("parts"))))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, sha256(text)[1:12] AS short_hash FROM documents")
def content_hash(spark, sf_dir):
    hashed = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashed.alias("content_hash"), F.substring(hashed, 1, 12).alias("short_hash")
    )
