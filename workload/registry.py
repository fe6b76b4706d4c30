"""Guards, listings, latest rows, dashboards, job states and deletions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import dashboard, jobs, registry
from workload import query, table

# --- duplicate guards ---------------------------------------------------------------------

# Documents of half the sources are registered already; identity is the text's hash.
KNOWN = "known AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE source IN ('src0', 'src1'))"
INCOMING = "incoming AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents)"


def _documents(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    return hashed, hashed.where(F.col("source").isin("src0", "src1")).select("content_hash")


@query(
    "duplicate_guard",
    f"""WITH {KNOWN}, {INCOMING}
    SELECT doc_id, source, content_hash FROM (
      SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS place FROM incoming)
    WHERE place > 1 OR content_hash IN (SELECT content_hash FROM known)""",
)
def duplicate_guard(spark, sf_dir):
    incoming, known = _documents(spark, sf_dir)
    return registry.reject_known(incoming, known, ["content_hash"], "doc_id")


@query(
    "accepted_new",
    f"""WITH {KNOWN}, {INCOMING}
    SELECT doc_id, source, content_hash FROM (
      SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS place FROM incoming)
    WHERE place = 1 AND content_hash NOT IN (SELECT content_hash FROM known)""",
)
def accepted_new(spark, sf_dir):
    incoming, known = _documents(spark, sf_dir)
    return registry.accept_new(incoming, known, ["content_hash"], ["doc_id"])


@query(
    "register_guard",
    """WITH incoming AS (SELECT o_orderkey AS id, o_custkey % 100 AS project_id, o_orderpriority AS name,
        o_orderstatus AS version FROM orders),
    known AS (SELECT DISTINCT c_custkey % 100 AS project_id, '1-URGENT' AS name, 'F' AS version FROM customer
      WHERE c_nationkey = 3),
    firsts AS (SELECT min(id) AS id, project_id, name, version FROM incoming GROUP BY ALL)
    SELECT * FROM firsts WHERE (project_id, name, version) NOT IN (SELECT project_id, name, version FROM known)""",
)
def register_guard(spark, sf_dir):
    """New model versions: unique by project, name and version."""
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 100).alias("project_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("version"),
    )
    known = (
        table(spark, sf_dir, "customer")
        .where("c_nationkey = 3")
        .select((F.col("c_custkey") % 100).alias("project_id"), F.lit("1-URGENT").alias("name"), F.lit("F").alias("version"))
    )
    return registry.accept_new(incoming, known, ["project_id", "name", "version"], ["id"])


@query(
    "orphans",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def orphans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return registry.orphans(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "length_violations",
    """SELECT p_partkey, CASE WHEN length(p_name) NOT BETWEEN 3 AND 12 THEN 'p_name'
      WHEN length(p_type) NOT BETWEEN 1 AND 5 THEN 'p_type' END AS field FROM part""",
)
def length_violations(spark, sf_dir):
    field = registry.length_violations({"p_name": (3, 12), "p_type": (1, 5)})
    return table(spark, sf_dir, "part").select("p_partkey", field.alias("field"))


# --- latest and newest --------------------------------------------------------------------


def _checks(spark, sf_dir):
    """Orders as health checks of customers."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("health_score"),
        F.col("o_orderstatus").alias("status"),
    )


LATEST = """
latest AS (
  SELECT o_custkey AS project_id, o_orderkey AS id, o_totalprice AS health_score, o_orderstatus AS status
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
"""


@query("latest_check", f"WITH {LATEST} SELECT * FROM latest")
def latest_check(spark, sf_dir):
    newest = registry.latest_per_group(_checks(spark, sf_dir), ["project_id"])
    return newest.select("project_id", "id", "health_score", "status")


@query(
    "latest_with_report",
    f"""WITH {LATEST},
    reports AS (SELECT l_orderkey, max(l_tax) AS risk, count(*) AS findings FROM lineitem GROUP BY ALL)
    SELECT project_id, id, status, risk, coalesce(findings, 0) AS findings
    FROM latest LEFT JOIN reports ON l_orderkey = id""",
)
def latest_with_report(spark, sf_dir):
    newest = registry.latest_per_group(_checks(spark, sf_dir), ["project_id"])
    reports = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_tax").alias("risk"), F.count(F.lit(1)).alias("findings")
    )
    joined = newest.join(reports, "id", "left")
    return joined.select("project_id", "id", "status", "risk", F.coalesce("findings", F.lit(0)).alias("findings"))


@query(
    "report_of_check",
    """SELECT o_orderkey AS id, o_orderstatus AS status, max(l_tax) AS risk FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def report_of_check(spark, sf_dir):
    reports = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_tax").alias("risk"))
    return _checks(spark, sf_dir).select("id", "status").join(reports, "id")


def _jobs(spark, sf_dir):
    """Events as jobs of users."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("project_id"),
        F.col("event_type").alias("job_type"),
        F.when(F.col("value") > 20, "completed").otherwise("failed").alias("status"),
        F.col("ts").alias("created_at"),
        F.when(F.col("value") > 20, F.col("ts")).alias("finished_at"),
    )


@query(
    "recent_jobs",
    """SELECT user_id AS project_id, row_number() OVER w AS rank, event_id AS id, event_type AS job_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
    QUALIFY row_number() OVER w <= 5""",
)
def recent_jobs(spark, sf_dir):
    return dashboard.recent_jobs(_jobs(spark, sf_dir)).select("project_id", "rank", "id", "job_type")


@query("jobs_limit", "SELECT event_id AS id, event_type AS job_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def jobs_limit(spark, sf_dir):
    """The newest hundred jobs; the limit is the listing's own."""
    return registry.newest_first(_jobs(spark, sf_dir), limit=100).select("id", "job_type")


@query("jobs_total", "SELECT least(count(*), 500) AS total FROM events")
def jobs_total(spark, sf_dir):
    return registry.listing_total(registry.newest_first(_jobs(spark, sf_dir), limit=500))


@query(
    "list_newest",
    """SELECT o_orderkey AS id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_on
    FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders) ORDER BY o_orderdate DESC, o_orderkey DESC""",
)
def list_newest(spark, sf_dir):
    """The listing of one project: the customer with the largest key that ordered."""
    checks = _checks(spark, sf_dir)
    project = checks.agg(F.max("project_id")).first()[0]
    rows = registry.newest_first(registry.where_equal(checks, project_id=project))
    return rows.select("id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


# --- dashboards ---------------------------------------------------------------------------


@query(
    "project_counts",
    """SELECT n_nationkey AS project_id,
      (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS models,
      (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS datasets,
      (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS batches
    FROM nation""",
)
def project_counts(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"))
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "project_id")
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "project_id")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return dashboard.project_counts(nations, {"models": customers, "datasets": suppliers, "batches": orders})


@query(
    "dashboard",
    """WITH mine AS (SELECT n_nationkey AS project_id, n_name AS project_name FROM nation),
    checks AS (SELECT c_nationkey AS project_id, o_orderkey, o_orderdate, o_orderstatus, o_totalprice
      FROM orders JOIN customer ON c_custkey = o_custkey),
    latest AS (SELECT * FROM checks QUALIFY
      row_number() OVER (PARTITION BY project_id ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    risks AS (SELECT l_orderkey, max(l_tax) AS risk FROM lineitem GROUP BY ALL),
    listed AS (SELECT user_id % 25 AS project_id, event_id, ts, row_number() OVER
      (PARTITION BY user_id % 25 ORDER BY ts DESC, event_id DESC) AS place FROM events),
    recent AS (SELECT project_id, string_agg(event_id::VARCHAR, ',' ORDER BY place) AS recent_job_ids,
      string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY place) AS recent_job_times
      FROM listed WHERE place <= 5 GROUP BY ALL)
    SELECT project_id, project_name,
      (SELECT count(*) FROM customer WHERE c_nationkey = project_id) AS models,
      (SELECT count(*) FROM supplier WHERE s_nationkey = project_id) AS datasets,
      (SELECT count(*) FROM checks c WHERE c.project_id = mine.project_id) AS prediction_batches,
      (SELECT count(*) FROM checks c WHERE c.project_id = mine.project_id) AS health_checks,
      o_orderkey AS health_check_id, o_orderstatus AS status, o_totalprice AS health_score, risk::VARCHAR AS risk_level,
      recent_job_ids, recent_job_times
    FROM mine LEFT JOIN latest USING (project_id) LEFT JOIN risks ON l_orderkey = o_orderkey
    LEFT JOIN recent USING (project_id)""",
)
def project_dashboard(spark, sf_dir):
    """Nations as projects, customers as models, suppliers as datasets, orders as checks."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer")
    models = customers.select(F.col("c_nationkey").alias("project_id"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    checks = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").alias("project_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("health_score"),
        F.struct(F.col("o_totalprice").alias("f1")).alias("metrics"),
        F.struct(F.col("o_totalprice").alias("performance_score")).alias("component_scores"),
        F.struct(F.array().cast("array<string>").alias("drifted_features")).alias("drift"),
    )
    reports = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("health_check_id"))
        .agg(F.max("l_tax").cast("string").alias("risk_level"))
        .withColumns(
            {"retraining_recommended": F.lit(False), "recommendations": F.array().cast("array<string>")}
        )
    )
    listed = _jobs(spark, sf_dir).withColumn("project_id", F.col("project_id") % 25)
    listed = listed.withColumn("created_at", F.col("created_at").cast("timestamp"))
    listed = listed.withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    batches = checks.select("project_id")
    rows = dashboard.project_dashboard(nations, models, suppliers, batches, checks, reports, listed)
    health, recent = F.col("latest_health"), F.col("recent_jobs")
    return rows.select(
        "project_id",
        "project_name",
        "models",
        "datasets",
        "prediction_batches",
        "health_checks",
        health["health_check_id"].alias("health_check_id"),
        health["status"].alias("status"),
        health["health_score"].alias("health_score"),
        health["risk_level"].alias("risk_level"),
        F.array_join(F.transform(recent, lambda j: j["id"].cast("string")), ",").alias("recent_job_ids"),
        F.array_join(F.transform(recent, lambda j: j["created_at"]), ",").alias("recent_job_times"),
    )


# --- jobs ---------------------------------------------------------------------------------


@query(
    "job_state",
    """WITH staged AS (
      SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed'
        WHEN 'click' THEN 'running' ELSE 'queued' END AS status,
        CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS error_message FROM events)
    SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS event_count,
      round(epoch(max(ts) FILTER (status IN ('completed', 'failed')) - max(ts) FILTER (status = 'running')), 3)
        AS duration_seconds,
      max_by(coalesce(error_message, ''), (ts, event_id)) AS error_message
    FROM staged GROUP BY job_id""",
)
def job_state(spark, sf_dir):
    """Each user's events folded to one job state."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "click", "running")
    ).otherwise("queued")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("event_at"),
        "event_id",
        F.when(kind == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error_message"),
    )
    states = jobs.job_states(events, ["event_at", "event_id"])
    return states.select(
        "job_id",
        "status",
        "event_count",
        F.round("duration_seconds", 3).alias("duration_seconds"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


@query(
    "job_leases",
    """WITH asked AS (SELECT user_id % 500 AS job_id, event_id % 20 AS owner, ts AS asked_at,
        CASE WHEN event_type = 'error' THEN ts ELSE ts + to_seconds(CAST(floor(value * 20000) AS BIGINT)) END AS until FROM events),
    last AS (SELECT job_id, owner, min(asked_at) AS asked_at, arg_max(until, asked_at) AS until FROM asked GROUP BY ALL),
    running AS (SELECT * FROM last WHERE until > (SELECT max(ts) FROM events))
    SELECT job_id, owner, floor(epoch(until))::BIGINT AS until FROM running
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY asked_at, owner) = 1""",
)
def job_leases(spark, sf_dir):
    """Events as requests of twenty owners for jobs; errors give a lease back."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    until = F.when(F.col("event_type") == "error", F.col("ts")).otherwise(
        F.col("ts") + F.make_dt_interval(secs=(F.col("value") * 20000).cast("bigint").cast("decimal(18,6)"))
    )
    asked = events.select((F.col("user_id") % 500).alias("job_id"), (F.col("event_id") % 20).alias("owner"), F.col("ts").alias("asked_at"), until.alias("until"))
    now = F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp")
    return jobs.held_leases(asked, now).select("job_id", "owner", F.unix_seconds("until").alias("until"))


# --- deletion -----------------------------------------------------------------------------

CASCADE = {
    "nation": {"region": "n_regionkey"},
    "customer": {"nation": "c_nationkey"},
    "orders": {"customer": "o_custkey"},
    "lineitem": {"orders": "l_orderkey"},
}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}


@query(
    "cascade_delete",
    """WITH n AS (SELECT * FROM nation WHERE n_regionkey NOT IN (1, 3)),
    c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
    o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
    l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT 'region' AS name, count(*) AS rows, sum(r_regionkey)::DOUBLE AS total FROM region WHERE r_regionkey NOT IN (1, 3)
    UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::DOUBLE FROM n
    UNION ALL SELECT 'customer', count(*), sum(c_custkey)::DOUBLE FROM c
    UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::DOUBLE FROM o
    UNION ALL SELECT 'lineitem', count(*), round(sum(l_quantity), 2) FROM l""",
)
def cascade_delete(spark, sf_dir):
    """Two regions go, with everything that hangs on them."""
    tables = {}
    for name in ("region", *CASCADE):
        rows = table(spark, sf_dir, name)
        tables[name] = rows.withColumnRenamed(KEYS[name], "id") if name in KEYS else rows
    doomed = tables["region"].where(F.col("id").isin(1, 3))
    left = registry.cascade_delete(tables, "region", doomed, CASCADE)
    result = None
    for name, rows in left.items():
        measure = F.col("id") if "id" in rows.columns else F.col("l_quantity")
        counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(measure).cast("double"), 2).alias("total"))
        part = counted.select(F.lit(name).alias("name"), "rows", "total")
        result = part if result is None else result.unionByName(part)
    return result
