"""Drift measures: PSI, Kolmogorov-Smirnov, total variation, and their summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.statistics import ks_p_value
from tidewatch.operators import drift
from tidewatch.operators.frequency import frequency_table
from workload import query, r9, table
from workload.proxies import BATCH_SQL, EVENT_SPLIT, FEATURES, NUMBERS, ORDER_SPLIT, SPLIT, batch_of, before, split_lineitem

# --- SQL building blocks ------------------------------------------------------------------


def observed(source: str, is_ref: str, features: dict[str, str], keys: str = "") -> str:
    """CTE ``obs``: one row per value of a feature; ``features`` maps expression to kind."""
    parts = []
    for name, (expression, kind) in features.items():
        number = f"({expression})::DOUBLE" if kind == "numeric" else "NULL::DOUBLE"
        text = "NULL::VARCHAR" if kind == "numeric" else f"coalesce(({expression})::VARCHAR, 'MISSING')"
        parts.append(
            f"""SELECT {keys} '{name}' AS feature, '{kind}' AS kind, {number} AS num, {text} AS txt,
            CASE WHEN {is_ref} THEN 1 ELSE 0 END AS ref, CASE WHEN {is_ref} THEN 0 ELSE 1 END AS cur FROM {source}"""
        )
    return "obs AS (" + " UNION ALL ".join(parts) + ")"


def columns(names: list[str]) -> dict[str, tuple[str, str]]:
    return {n: (n, "categorical" if n.endswith("flag") else "numeric") for n in names}


def p_value_sql(d: str, n: str, m: str) -> str:
    """P-value of large samples: the one-sample distribution of the effective size."""
    e = f"(round({n}::DOUBLE * {m} / ({n} + {m})))"
    z2 = f"({e} * {d} * {d})"
    q = "(pi() * pi() * (k - 0.5::DOUBLE) * (k - 0.5::DOUBLE))"
    w = "(pi() * pi() * k * k::DOUBLE)"

    def total(term: str) -> str:
        return f"list_sum(list_transform(range(-20, 21), lambda k: {term}))"

    eq, ew = f"exp(-{q} / (2 * {z2}))", f"exp(-{w} / (2 * {z2}))"
    root = "sqrt(pi() / 2)"
    z = f"sqrt({z2})"
    k0 = f"{root} / {z} * {total(eq)}"
    k1 = f"{root} / (6 * {z2} * {z2}) * {total(f'({q} - {z2}) * {eq}')}"
    k2a = f"(6 * {z2}**3 + 2 * {z2}**2 + {q} * (2 * {z2}**2 - 5 * {z2}) + {q}**2 * (1 - 2 * {z2})) * {eq}"
    k2 = f"({root} / (72 * {z}**7) * {total(k2a)} - {root} / (36 * {z}**3) * {total(f'{w} * {ew}')})"
    k3a = (
        f"({q}**3 * (5 - 30 * {z2}) + {q}**2 * (-60 * {z2} + 212 * {z2}**2)"
        f" + {q} * (135 * {z2}**2 - 96 * {z2}**3) - 30 * {z2}**3 - 90 * {z2}**4) * {eq}"
    )
    k3b = f"(-({w}**2) + 3 * {w} * {z2}) * {ew}"
    k3 = f"({root} / (6480 * {z}**10) * {total(k3a)} + {root} / (108 * {z2}**3) * {total(k3b)})"
    series = f"(1 - ({k0} + ({k1}) / sqrt({e}) + {k2} / {e} + {k3} / {e}**1.5::DOUBLE))"
    tail = f"""(2 * {d} * list_sum(list_transform(range(0, floor({e} * (1 - {d}))::BIGINT + 1), lambda j:
        CASE WHEN 1 - {d} - j / {e} > 0 THEN
        exp(lgamma({e} + 1) - lgamma(j + 1) - lgamma({e} - j + 1) + (j - 1) * ln({d} + j / {e})
            + ({e} - j) * ln(1 - {d} - j / {e})) ELSE 0 END)))"""
    return f"""greatest(0, least(1, CASE WHEN {e} * {d} <= 0.5 THEN 1 WHEN {d} >= 1 THEN 0
        WHEN {z2} >= 2.2 THEN {tail} ELSE {series} END))"""


def drift_ctes(keys: str = "", edges: bool = True) -> str:
    """CTEs from ``obs`` to ``drift`` (one row per keys and feature)."""
    by = f"{keys}feature"
    return f"""
    freq AS (SELECT {keys} feature, kind, num, txt, sum(ref)::BIGINT AS ref_n, sum(cur)::BIGINT AS cur_n
             FROM obs GROUP BY ALL),
    numbers AS (SELECT * FROM freq WHERE kind = 'numeric' AND num IS NOT NULL),
    cum AS (SELECT *, sum(ref_n) OVER upto AS cr, sum(cur_n) OVER upto AS cc,
              sum(ref_n) OVER whole AS n, sum(cur_n) OVER whole AS m
            FROM numbers
            WINDOW upto AS (PARTITION BY {by} ORDER BY num ROWS UNBOUNDED PRECEDING),
                   whole AS (PARTITION BY {by})),
    ks AS (SELECT {by}, max(abs(cr::DOUBLE / n - cc::DOUBLE / m)) AS d, max(n)::BIGINT AS n, max(m)::BIGINT AS m
           FROM cum GROUP BY ALL),
    levels AS (SELECT j, CASE WHEN j = 10 THEN 1::DOUBLE ELSE j * 0.1::DOUBLE END AS q
               FROM (SELECT unnest(range(0, 11)) AS j)),
    ranks AS (
      SELECT {by}, j, any_value((n - 1) * q) AS p,
        max(CASE WHEN cr - ref_n <= floor((n - 1) * q) AND floor((n - 1) * q) < cr THEN num END) AS lo,
        max(CASE WHEN cr - ref_n <= ceil((n - 1) * q) AND ceil((n - 1) * q) < cr THEN num END) AS hi
      FROM cum CROSS JOIN levels WHERE ref_n > 0 GROUP BY {by}, j),
    edge_rows AS (
      SELECT {by}, CASE WHEN lo = hi THEN lo WHEN p - floor(p) < 0.5 THEN lo + (hi - lo) * (p - floor(p))
               ELSE hi - (hi - lo) * (1 - (p - floor(p))) END AS e FROM ranks),
    edges AS (SELECT {by}, list_sort(list_distinct(list(e))) AS edges FROM edge_rows GROUP BY {by}),
    binned AS (
      SELECT {by}, ref_n, cur_n,
        CASE WHEN len(edges) = 1 THEN CASE WHEN abs(num - edges[1]) <= 0.5 THEN 1 END
             ELSE least(greatest(len(list_filter(edges, lambda x: x <= num)), 1), len(edges) - 1) END AS bin
      FROM numbers JOIN edges USING ({by})),
    hist AS (SELECT {by}, bin, sum(ref_n)::DOUBLE AS r, sum(cur_n)::DOUBLE AS c FROM binned
             WHERE bin IS NOT NULL GROUP BY {by}, bin),
    shares AS (
      SELECT {by}, greatest(r / nullif(sum(r) OVER whole, 0), 1e-6) AS rp,
        CASE WHEN sum(c) OVER whole > 0 THEN greatest(c / sum(c) OVER whole, 1e-6) END AS cp
      FROM hist WINDOW whole AS (PARTITION BY {by})),
    psi AS (SELECT {by}, sum((cp - rp) * ln(cp / rp)) AS psi FROM shares GROUP BY {by}),
    category AS (
      SELECT {by}, txt, ref_n::DOUBLE / sum(ref_n) OVER whole AS rs, cur_n::DOUBLE / sum(cur_n) OVER whole AS cs
      FROM freq WHERE kind = 'categorical' WINDOW whole AS (PARTITION BY {by})),
    tvd AS (SELECT {by}, 0.5::DOUBLE * sum(abs(cs - rs)) AS tvd FROM category GROUP BY {by}),
    measured AS (
      SELECT {by}, 'numeric' AS feature_type, psi, d AS ks_statistic, {p_value_sql('d', 'n', 'm')} AS ks_p_value,
        NULL::DOUBLE AS tvd
      FROM ks JOIN psi USING ({by})
      UNION ALL SELECT {by}, 'categorical', NULL, NULL, NULL, tvd FROM tvd),
    drift AS (
      SELECT *, CASE WHEN feature_type = 'numeric' THEN
            CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 OR ks_p_value < 0.05 THEN 'warning' ELSE 'stable' END
          ELSE CASE WHEN tvd >= 0.25 THEN 'critical' WHEN tvd >= 0.1 THEN 'warning' ELSE 'stable' END END AS severity
      FROM measured)
    """


def summary_sql(keys: str = "") -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""SELECT {keys} count(*) AS feature_count,
      count(*) FILTER (severity <> 'stable') AS drifted_feature_count,
      count(*) FILTER (severity <> 'stable')::DOUBLE / count(*) AS drift_rate,
      coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (severity <> 'stable'), '') AS drifted_features
      FROM drift {group}"""


SHOWN = """feature, feature_type, round(psi, 9) AS psi, round(ks_statistic, 9) AS ks_statistic,
  round(ks_p_value, 6) AS ks_p_value, round(tvd, 9) AS tvd, severity"""

ITEM_REF = f"l_shipdate < TIMESTAMP '{SPLIT}'"
ITEM_OBS = observed("lineitem", ITEM_REF, columns(FEATURES))
NUMBER_OBS = observed("lineitem", ITEM_REF, columns(NUMBERS))
ORDER_OBS = observed("orders", f"o_orderdate < TIMESTAMP '{ORDER_SPLIT}'", {"o_totalprice": ("o_totalprice", "numeric")})
EVENT_REF = f"ts < TIMESTAMP '{EVENT_SPLIT}'"
EVENT_OBS = observed("events", EVENT_REF, {"value": ("value", "numeric")}, "event_type, ")


def _split_orders(spark, sf_dir, *names):
    orders = table(spark, sf_dir, "orders")
    early = before("o_orderdate", ORDER_SPLIT)
    return orders.where(early).select(*names), orders.where(~early).select(*names)


def _split_events(spark, sf_dir, *names):
    events = table(spark, sf_dir, "events")
    early = before("ts", EVENT_SPLIT)
    return events.where(early).select(*names), events.where(~early).select(*names)


def _totals(sides, keys=()):
    return drift.numeric_totals(frequency_table(*sides, list(keys)), list(keys))


def _psi(sides, keys=()):
    keys = list(keys)
    totals = _totals(sides, keys)
    return drift.psi(drift.histogram(totals, drift.quantile_edges(totals, keys), keys), keys).select(
        *keys, "feature", r9("psi")
    )


def drift_rows(result, keys=()):
    shown = [r9("psi"), r9("ks_statistic"), F.round("ks_p_value", 6).alias("ks_p_value"), r9("tvd"), "severity"]
    return result.select(*keys, "feature", "feature_type", *shown)


# --- queries ------------------------------------------------------------------------------


@query("psi_numeric", f"WITH {NUMBER_OBS}, {drift_ctes()} SELECT feature, round(psi, 9) AS psi FROM psi")
def psi_numeric(spark, sf_dir):
    return _psi(split_lineitem(spark, sf_dir, NUMBERS))


@query("psi_orders", f"WITH {ORDER_OBS}, {drift_ctes()} SELECT feature, round(psi, 9) AS psi FROM psi")
def psi_orders(spark, sf_dir):
    return _psi(_split_orders(spark, sf_dir, "o_totalprice"))


@query(
    "psi_by_event_type",
    f"WITH {EVENT_OBS}, {drift_ctes('event_type, ')} SELECT event_type, feature, round(psi, 9) AS psi FROM psi",
)
def psi_by_event_type(spark, sf_dir):
    return _psi(_split_events(spark, sf_dir, "event_type", "value"), ["event_type"])


@query(
    "psi_constant_reference",
    f"""WITH {observed("events", EVENT_REF, {
        "value": (f"CASE WHEN {EVENT_REF} THEN 5 ELSE CASE WHEN event_type = 'click' THEN 9 ELSE value END END", "numeric")
    }, "event_type, ")}, {drift_ctes("event_type, ")}
    SELECT event_type, feature, round(psi, 9) AS psi FROM psi""",
)
def psi_constant_reference(spark, sf_dir):
    """A constant reference keeps only values within half a unit; clicks leave none."""
    reference, current = _split_events(spark, sf_dir, "event_type", "value")
    reference = reference.withColumn("value", F.col("value") * 0 + 5)
    current = current.withColumn("value", F.when(F.col("event_type") == "click", 9.0).otherwise(F.col("value")))
    return _psi((reference, current), ["event_type"])


@query(
    "quantile_edges",
    f"""WITH {NUMBER_OBS}, {drift_ctes()}
    SELECT feature, i AS position, round(edges[i], 9) AS edge FROM edges, unnest(range(1, len(edges) + 1)) AS t(i)""",
)
def quantile_edges(spark, sf_dir):
    edges = drift.quantile_edges(_totals(split_lineitem(spark, sf_dir, NUMBERS)))
    return edges.select("feature", F.posexplode("edges").alias("position", "edge")).select(
        "feature", (F.col("position") + 1).cast("long").alias("position"), r9("edge")
    )


@query(
    "histogram_bins",
    f"""WITH {NUMBER_OBS}, {drift_ctes()}
    SELECT feature, bin::BIGINT AS bin, r::BIGINT AS ref_n, c::BIGINT AS cur_n FROM hist""",
)
def histogram_bins(spark, sf_dir):
    totals = _totals(split_lineitem(spark, sf_dir, NUMBERS))
    bins = drift.histogram(totals, drift.quantile_edges(totals))
    return bins.withColumn("bin", F.col("bin").cast("long"))


KS_SHOWN = "round(d, 9) AS ks_statistic, n AS ref_n, m AS cur_n"


@query("ks_statistic", f"WITH {NUMBER_OBS}, {drift_ctes()} SELECT feature, {KS_SHOWN} FROM ks")
def ks_statistic(spark, sf_dir):
    rows = drift.ks_statistic(_totals(split_lineitem(spark, sf_dir, NUMBERS)))
    return rows.select("feature", r9("ks_statistic"), "ref_n", "cur_n")


@query(
    "ks_statistic_by_event_type",
    f"WITH {EVENT_OBS}, {drift_ctes('event_type, ')} SELECT event_type, feature, {KS_SHOWN} FROM ks",
)
def ks_statistic_by_event_type(spark, sf_dir):
    sides = _split_events(spark, sf_dir, "event_type", "value")
    rows = drift.ks_statistic(_totals(sides, ["event_type"]), ["event_type"])
    return rows.select("event_type", "feature", r9("ks_statistic"), "ref_n", "cur_n")


@query(
    "ks_pvalue_large_samples",
    f"""WITH {NUMBER_OBS}, {drift_ctes()}
    SELECT feature, round({p_value_sql('d', 'n', 'm')}, 6) AS ks_p_value FROM ks""",
)
def ks_pvalue_large_samples(spark, sf_dir):
    rows = drift.ks_statistic(_totals(split_lineitem(spark, sf_dir, NUMBERS)))
    p_value = ks_p_value(F.col("ks_statistic"), F.col("ref_n"), F.col("cur_n"))
    return rows.select("feature", F.round(p_value, 6).alias("ks_p_value"))


# Orderings of both samples walk a lattice; ``r[i + 1]`` is the share of the ways to (i, s - i)
# that have left the band. Steps are ints, so the band is exact.
EXACT_SQL = f"""WITH RECURSIVE {EVENT_OBS}, {drift_ctes('event_type, ')},
sizes AS (
  SELECT event_type, n, m, m // gcd(n, m) AS up, n // gcd(n, m) AS across, round(d * (m // gcd(n, m)) * n)::BIGINT AS gap FROM ks),
walk AS (
  SELECT event_type, n, m, up, across, gap, 0::BIGINT AS s,
    list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END) AS r FROM sizes
  UNION ALL
  SELECT event_type, n, m, up, across, gap, s + 1,
    list_transform(list_zip(range(0, n + 1), r, list_prepend(1::DOUBLE, r[:n])), lambda c:
      CASE WHEN abs(c[1] * up - (s + 1 - c[1]) * across) >= gap THEN 1::DOUBLE
        ELSE (CASE WHEN c[1] > 0 THEN c[3] * c[1] ELSE 0 END + c[2] * greatest(s + 1 - c[1], 0)) / (s + 1) END)
  FROM walk WHERE s < n + m)
SELECT event_type, n AS ref_n, m AS cur_n, round(CASE WHEN gap = 0 THEN 1 ELSE least(1, greatest(0, r[n + 1])) END, 9) AS ks_p_value
FROM walk WHERE s = n + m"""


@query("ks_pvalue_exact", EXACT_SQL)
def ks_pvalue_exact(spark, sf_dir):
    """The exact distribution per event type, whatever the sample sizes."""
    sides = _split_events(spark, sf_dir, "event_type", "value")
    rows = drift.ks_statistic(_totals(sides, ["event_type"]), ["event_type"])
    p_value = ks_p_value(F.col("ks_statistic"), F.col("ref_n"), F.col("cur_n"), "exact")
    return rows.select("event_type", "ref_n", "cur_n", r9(p_value, "ks_p_value"))


CATEGORY_OBS = observed(
    "orders",
    f"o_orderdate < TIMESTAMP '{ORDER_SPLIT}'",
    {
        "o_orderpriority": ("o_orderpriority", "categorical"),
        "o_orderstatus": ("nullif(o_orderstatus, 'P')", "categorical"),
    },
)


def _order_categories(spark, sf_dir):
    sides = _split_orders(spark, sf_dir, "o_orderpriority", "o_orderstatus")
    return [s.withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P"))) for s in sides]


@query("tvd_categorical", f"WITH {CATEGORY_OBS}, {drift_ctes()} SELECT feature, round(tvd, 9) AS tvd FROM tvd")
def tvd_categorical(spark, sf_dir):
    return drift.total_variation(frequency_table(*_order_categories(spark, sf_dir))).select("feature", r9("tvd"))


@query(
    "tvd_category_differences",
    f"""WITH {CATEGORY_OBS}, {drift_ctes()}
    SELECT feature, txt AS category, round(rs, 9) AS ref_share, round(cs, 9) AS cur_share,
      round(abs(cs - rs), 9) AS abs_difference FROM category""",
)
def tvd_category_differences(spark, sf_dir):
    rows = drift.category_differences(frequency_table(*_order_categories(spark, sf_dir)))
    return rows.select("feature", "category", r9("ref_share"), r9("cur_share"), r9("abs_difference"))


@query(
    "tvd_many_categories",
    f"""WITH {observed("orders", f"o_orderdate < TIMESTAMP '{ORDER_SPLIT}'", {"o_custkey": ("o_custkey::VARCHAR", "categorical")})},
    {drift_ctes()} SELECT feature, round(tvd, 9) AS tvd FROM tvd""",
)
def tvd_many_categories(spark, sf_dir):
    """Categories without a bound: customer keys as text."""
    sides = [s.withColumn("o_custkey", F.col("o_custkey").cast("string")) for s in _split_orders(spark, sf_dir, "o_custkey")]
    return drift.total_variation(frequency_table(*sides)).select("feature", r9("tvd"))


@query("feature_drift", f"WITH {ITEM_OBS}, {drift_ctes()} SELECT {SHOWN} FROM drift")
def feature_drift(spark, sf_dir):
    return drift_rows(drift.feature_drift(*split_lineitem(spark, sf_dir, FEATURES)))


@query("drift_summary", f"WITH {ITEM_OBS}, {drift_ctes()} {summary_sql()}")
def drift_summary(spark, sf_dir):
    rows = drift.drift_summary(drift.feature_drift(*split_lineitem(spark, sf_dir, FEATURES)))
    return rows.select(
        "feature_count",
        "drifted_feature_count",
        "drift_rate",
        F.array_join("drifted_features", ", ").alias("drifted_features"),
    )


SHIFTED = {
    "l_quantity": ("l_quantity", "numeric"),
    "l_discount": (f"CASE WHEN {ITEM_REF} THEN l_discount ELSE l_discount * 1.5::DOUBLE END", "numeric"),
    "l_returnflag": (f"CASE WHEN {ITEM_REF} OR l_returnflag <> 'N' THEN l_returnflag END", "categorical"),
    "l_tax": ("nullif(l_tax, 0.08::DOUBLE)", "numeric"),
}


def shifted_sides(spark, sf_dir, keys=None):
    """lineitem with a stretched discount, a lost category and missing taxes after the split."""
    names = ["l_quantity", "l_discount", "l_returnflag", "l_tax"]
    reference, current = split_lineitem(spark, sf_dir, names, keys)
    tax = F.nullif(F.col("l_tax"), F.lit(0.08))
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return reference.withColumn("l_tax", tax), current.withColumns(
        {"l_tax": tax, "l_discount": F.col("l_discount") * 1.5, "l_returnflag": flag}
    )


@query("drift_detected", f"WITH {observed('lineitem', ITEM_REF, SHIFTED)}, {drift_ctes()} SELECT {SHOWN} FROM drift")
def drift_detected(spark, sf_dir):
    return drift_rows(drift.feature_drift(*shifted_sides(spark, sf_dir)))




@query(
    "drift_by_batch",
    f"""WITH keyed AS (SELECT *, {BATCH_SQL} AS batch FROM lineitem),
    {observed("keyed", ITEM_REF, columns(FEATURES), "batch, ")}, {drift_ctes("batch, ")}
    SELECT batch, {SHOWN} FROM drift""",
)
def drift_by_batch(spark, sf_dir):
    """Eight batches, one of which holds two fifths of the rows."""
    sides = split_lineitem(spark, sf_dir, FEATURES, {"batch": batch_of()})
    return drift_rows(drift.feature_drift(*sides, ["batch"], method="asymptotic"), ["batch"])


@query(
    "json_feature_drift",
    f"""WITH {observed("events", EVENT_REF, {"k": ("(props->>'$.k')::DOUBLE", "numeric")})}, {drift_ctes()}
    SELECT feature, round(psi, 9) AS psi, round(d, 9) AS ks_statistic FROM psi JOIN ks USING (feature)""",
)
def json_feature_drift(spark, sf_dir):
    """Features flattened from JSON payloads."""
    sides = [s.select(F.from_json("props", "k DOUBLE").alias("p")).select("p.*") for s in _split_events(spark, sf_dir, "props")]
    return drift.feature_drift(*sides).select("feature", r9("psi"), r9("ks_statistic"))
