"""Deterministic job-queue tables derived from the generated test tables, once as DataFrames and once as DuckDB SQL.

The DataFrames feed the registered queries; the SQL texts are common table expressions for their oracles, written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import at, plus

BASE, AS_OF = "2024-01-01 00:00:00", "2024-01-07 12:00:00"


def as_of():
    return at(AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs: one per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("k")
    slot = k % 16
    state = (
        F.when(slot.isin(6, 7), "available").when(slot == 8, "running").when(slot == 9, "scheduled").when(slot == 10, "retryable")
        .when(slot.isin(11, 12), "failed").when(slot == 13, "cancelled").when(slot == 14, "waiting_external").otherwise("completed")
    )
    is_ = lambda *s: F.col("state").isin(*s)
    j = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("long").alias("k"), F.lower("c_mktsegment").alias("queue"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p")
    )
    j = j.select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, ["send_email", "charge_card", "sync_inventory", "render_invoice"])), (k % 4 + 1).cast("int")).alias("kind"),
        "queue", state.alias("state"), F.least("p", F.lit(4)).alias("priority"), "k",
    )
    j = j.withColumn("attempt", F.when(is_("available", "scheduled"), 0).otherwise((1 + k % 3).cast("int"))).withColumn("run_lease", F.col("attempt").cast("long")).withColumn("max_attempts", F.lit(5))
    j = j.withColumn("created_at", plus(at(BASE), (k * 7919) % 561600))
    j = j.withColumn("run_at", plus("created_at", (k * 104729) % 1800 + F.when(is_("scheduled"), 7200 + (k * 104729) % 86400).otherwise(0)))
    j = j.withColumn("finalized_at", F.when(is_("completed", "failed", "cancelled"), plus("run_at", 1 + (k * 1299709) % 900)))
    j = j.withColumn("heartbeat_at", F.when(is_("running"), plus(at(AS_OF), -(k % 180)))).withColumn("attempted_at", F.when(F.col("attempt") > 0, plus("run_at", k % 60)))
    j = j.withColumn("deadline_at", F.when(is_("running"), plus(at(AS_OF), k % 601 - 300)))
    j = j.withColumn("callback_id", F.when(is_("waiting_external"), F.concat(F.lit("cb-"), k.cast("string")))).withColumn("callback_timeout_at", F.when(is_("waiting_external"), plus(at(AS_OF), k % 1001 - 500)))
    j = j.withColumn("tags", F.when(k % 3 == 0, F.array(F.concat(F.lit("seg-"), (k % 7).cast("string")))).otherwise(F.array(F.concat(F.lit("seg-"), (k % 7).cast("string")), F.concat(F.lit("tier-"), (k % 5).cast("string")))))
    j = j.withColumn("unique_key", F.when(k % 10 == 0, F.md5(F.concat_ws("|", "queue", "kind", (k % 500).cast("string")))))
    j = j.withColumn("unique_states", F.when((k % 10 == 0) & (k % 20 != 0), F.lit("11111000")))
    error = lambda i: F.struct((F.col("attempt") - i).alias("attempt"), F.concat(F.lit("boom "), (k % 9).cast("string")).alias("error"), plus("run_at", -60 * i).alias("at"), ((k % 5 == 0) & F.lit(i == 0)).alias("terminal"))
    count = F.when(is_("failed"), F.least(F.col("attempt"), F.lit(2))).when(is_("retryable"), F.lit(1)).otherwise(0)
    j = j.withColumn("errors", F.reverse(F.slice(F.array(error(0), error(1)), F.lit(1), count)))
    return j.withColumn("metadata", F.when(k % 11 == 0, F.concat(F.lit('{"original_priority":'), F.least(F.col("priority") + 1, F.lit(4)).cast("string"), F.lit("}"))).otherwise(F.lit("{}"))).drop("k")


JOBS = f"""
src AS (
  SELECT o_orderkey::BIGINT AS k, lower(c_mktsegment) AS queue, CAST(left(o_orderpriority, 1) AS INTEGER) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey),
staged AS (
  SELECT *, CASE WHEN k % 16 IN (6, 7) THEN 'available' WHEN k % 16 = 8 THEN 'running' WHEN k % 16 = 9 THEN 'scheduled' WHEN k % 16 = 10 THEN 'retryable'
    WHEN k % 16 IN (11, 12) THEN 'failed' WHEN k % 16 = 13 THEN 'cancelled' WHEN k % 16 = 14 THEN 'waiting_external' ELSE 'completed' END AS state FROM src),
timed AS (
  SELECT *, CASE WHEN state IN ('available', 'scheduled') THEN 0 ELSE (1 + k % 3)::INTEGER END AS attempt,
    TIMESTAMP '{BASE}' + to_seconds((k * 7919) % 561600) AS created_at FROM staged),
due AS (
  SELECT *, created_at + to_seconds((k * 104729) % 1800 + CASE WHEN state = 'scheduled' THEN 7200 + (k * 104729) % 86400 ELSE 0 END) AS run_at FROM timed),
jobs AS (
  SELECT k AS id, ['send_email', 'charge_card', 'sync_inventory', 'render_invoice'][k % 4 + 1] AS kind, queue, state, least(p, 4) AS priority,
    attempt, attempt::BIGINT AS run_lease, 5 AS max_attempts, created_at, run_at,
    CASE WHEN state IN ('completed', 'failed', 'cancelled') THEN run_at + to_seconds(1 + (k * 1299709) % 900) END AS finalized_at,
    CASE WHEN state = 'running' THEN TIMESTAMP '{AS_OF}' - to_seconds(k % 180) END AS heartbeat_at,
    CASE WHEN attempt > 0 THEN run_at + to_seconds(k % 60) END AS attempted_at,
    CASE WHEN state = 'running' THEN TIMESTAMP '{AS_OF}' + to_seconds(k % 601 - 300) END AS deadline_at,
    CASE WHEN state = 'waiting_external' THEN 'cb-' || k END AS callback_id,
    CASE WHEN state = 'waiting_external' THEN TIMESTAMP '{AS_OF}' + to_seconds(k % 1001 - 500) END AS callback_timeout_at,
    CASE WHEN k % 3 = 0 THEN ['seg-' || (k % 7)] ELSE ['seg-' || (k % 7), 'tier-' || (k % 5)] END AS tags,
    CASE WHEN k % 10 = 0 THEN md5(queue || '|' || ['send_email', 'charge_card', 'sync_inventory', 'render_invoice'][k % 4 + 1] || '|' || (k % 500)) END AS unique_key,
    CASE WHEN k % 10 = 0 AND k % 20 <> 0 THEN '11111000' END AS unique_states,
    CASE WHEN state = 'failed' THEN least(attempt, 2) WHEN state = 'retryable' THEN 1 ELSE 0 END AS n_errors,
    CASE WHEN k % 11 = 0 THEN least(least(p, 4) + 1, 4) END AS first_priority
  FROM due)"""


def jobs_sql(body: str, *more: str) -> str:
    """A query over the jobs, with AS_OF written as :now."""
    return f"WITH {', '.join([JOBS, *more])} {body}".replace(":now", f"TIMESTAMP '{AS_OF}'")


# Small tables as literals.
QUEUE_META = [("automobile", False, None, None), ("building", False, 7200, None), ("furniture", False, 3600, 7200), ("machinery", True, None, None), ("ghost", True, None, None)]
QUEUE_META_COLUMNS = "queue string, paused boolean, completed_retention_s int, failed_retention_s int"
DESCRIPTORS = [
    ("automobile", "Automobile", "fleet", 10_000, "2024-01-07 11:59:50"),
    ("building", "Building", "sites", 60_000, "2024-01-07 11:56:00"),
    ("household", "Household", None, 1_500, "2024-01-07 11:59:20"),
    ("archive", "Archive", "ops", 10_000, "2024-01-07 11:59:29"),
]
DESCRIPTOR_COLUMNS = "queue string, display_name string, owner string, sync_interval_ms long, last_seen_at string"
INSTANCES = [
    (f"w{i:02}", f"1.{i % 4}.{i}" if i != 5 else "0.9", f"2024-01-07 11:{59 - (i * 7) % 50:02}:{(i * 13) % 60:02}", 10_000 if i % 3 else 30_500, i % 4 != 1, i == 0, i % 5 != 0,
     [("automobile", "h1" if i % 6 else "h2"), ("building", "h9")][: 1 + i % 2], [("automobile", 50 + 10 * (i % 2), None if i == 2 else i % 2 == 0), ("building", 20, True)][: 1 + i % 2])
    for i in range(12)
]
INSTANCE_COLUMNS = (
    "instance_id string, version string, last_seen_at string, snapshot_interval_ms long, healthy boolean, leader boolean, shutting_down boolean, "
    "hashes array<struct<name: string, hash: string>>, queues array<struct<queue: string, max_workers: int, dlq: boolean>>"
)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a relation that the planner sees through: no job reads it, and joins with it are broadcast."""

    def text(x) -> str:
        if isinstance(x, (list, tuple)):
            return f"{'array' if isinstance(x, list) else 'struct'}({', '.join(map(text, x))})"
        return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"

    kinds = spark.createDataFrame([], schema).dtypes
    names = [f"c{i}" for i in range(len(kinds))]
    typed = ", ".join(f"CAST({c} AS {t}) AS `{n}`" for c, (n, t) in zip(names, kinds, strict=True))
    return spark.sql(f"SELECT {typed} FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({', '.join(names)})")


def queue_meta(spark: SparkSession) -> DataFrame:
    return small(spark, QUEUE_META, QUEUE_META_COLUMNS)


def descriptors(spark: SparkSession) -> DataFrame:
    return small(spark, DESCRIPTORS, DESCRIPTOR_COLUMNS).withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp_ntz"))


def instances(spark: SparkSession) -> DataFrame:
    return small(spark, INSTANCES, INSTANCE_COLUMNS).withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp_ntz"))


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (bool, int, float)):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


META = values_sql("queue_meta", ["queue", "paused", "completed_retention_s", "failed_retention_s"], QUEUE_META)
DESC = values_sql("raw_desc", ["queue", "display_name", "owner", "sync_interval_ms", "seen"], DESCRIPTORS) + ", queue_descriptors AS (SELECT * EXCLUDE seen, seen::TIMESTAMP AS last_seen_at FROM raw_desc)"
INST = values_sql("raw_inst", ["instance_id", "version", "seen", "snapshot_interval_ms", "healthy", "leader", "shutting_down"], [r[:7] for r in INSTANCES]) + ", instances AS (SELECT * EXCLUDE seen, seen::TIMESTAMP AS last_seen_at FROM raw_inst)"
HASHES = values_sql("hashes", ["instance_id", "name", "hash"], [(r[0], *h) for r in INSTANCES for h in r[7]])
INST_QUEUES = values_sql("inst_queues", ["instance_id", "queue", "max_workers", "dlq"], [(r[0], *q) for r in INSTANCES for q in r[8]])


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job's place in its lane: lane_seq from 1 in each (queue, priority, enqueue_shard)."""
    from pyspark.sql import Window

    j = jobs(spark, sf_dir).withColumn("enqueue_shard", (F.col("id") % 3).cast("int"))
    w = Window.partitionBy("queue", "priority", "enqueue_shard").orderBy("created_at", "id")
    return j.withColumn("lane_seq", F.row_number().over(w).cast("long")).withColumn("slot", (F.col("lane_seq") % 4).cast("int"))


LANES = "lanes AS (SELECT *, (id % 3)::INTEGER AS enqueue_shard, row_number() OVER (PARTITION BY queue, priority, id % 3 ORDER BY created_at, id) AS lane_seq FROM jobs)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events of jobs that are the users of the events table."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    kinds = {"click": "started", "view": "completed", "error": "retried", "purchase": "waiting", "signup": "cancelled"}
    name = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in kinds.items()], F.lit("started"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("job_id"), name.alias("event_type"), F.row_number().over(w).cast("long").alias("run_lease"))


EVENTS = """ev AS (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS job_id,
  CASE event_type WHEN 'click' THEN 'started' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'retried' WHEN 'purchase' THEN 'waiting' WHEN 'signup' THEN 'cancelled' ELSE 'started' END AS event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_lease FROM events)"""
