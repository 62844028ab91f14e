"""Registered read-side queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import STATES
from ..operators import reads as R
from ..registry import query
from ..sources import fixtures as X
from .common import plain

STATE_LIST = ", ".join(f"('{s}', {i})" for i, s in enumerate(STATES))
RECENT = "state = 'completed' AND finalized_at > :now - INTERVAL 1 HOUR AND finalized_at <= :now"
LIVE_SQL = "last_seen_at + to_seconds(greatest((greatest(snapshot_interval_ms, 1000) // 1000) * 3, 30)) >= :now"
JOB = "id, kind, queue, state, priority"


def _dlq(spark, sf):
    j = X.jobs(spark, sf).filter("state = 'failed' AND id % 32 = 11")
    return j.withColumn("dlq_at", F.timestamp_add("SECOND", F.lit(60), F.col("finalized_at"))).withColumn("dlq_reason", F.when(F.col("id") % 64 == 11, "terminal_error").otherwise("max_attempts_exhausted"))


DLQ = "dlq AS (SELECT *, finalized_at + INTERVAL 60 SECOND AS dlq_at, CASE WHEN id % 64 = 11 THEN 'terminal_error' ELSE 'max_attempts_exhausted' END AS dlq_reason FROM jobs WHERE state = 'failed' AND id % 32 = 11)"


@query("a01_union_view", X.jobs_sql("SELECT state, count(*) AS n, min(id) AS lo, max(id) AS hi FROM jobs GROUP BY state"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    hot, deferred = j.filter(~F.col("state").isin("scheduled", "retryable")), j.filter(F.col("state").isin("scheduled", "retryable"))
    return hot.unionByName(deferred).groupBy("state").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("a16_row_generator", "SELECT g, g * g % 7 AS v FROM generate_series(0, 999) t(g)")
def _(spark, sf):
    return spark.range(1000).select(F.col("id").alias("g"), (F.col("id") * F.col("id") % 7).alias("v"))


@query("b01_list_jobs", X.jobs_sql(f"SELECT {JOB}, array_to_string(tags, ',') AS tags FROM jobs WHERE state = 'completed' AND queue = 'building' AND list_contains(tags, 'tier-2') AND id < 40000 ORDER BY id DESC LIMIT 100"))
def _(spark, sf):
    return plain(R.list_jobs(X.jobs(spark, sf), states="completed", queue="building", tag="tier-2", before_id=40_000).select("id", "kind", "queue", "state", "priority", "tags"))


@query("b02_list_jobs_clamped", X.jobs_sql(f"SELECT {JOB} FROM jobs WHERE list_contains(tags, 'seg-3') ORDER BY id DESC LIMIT 1000"))
def _(spark, sf):
    return R.list_jobs(X.jobs(spark, sf), tag="seg-3", limit=5000, clamp=True).select("id", "kind", "queue", "state", "priority")


@query("b03_get_job", X.jobs_sql("SELECT id, state, attempt, created_at::VARCHAR AS created_at, run_at::VARCHAR AS run_at, finalized_at::VARCHAR AS finalized_at FROM jobs WHERE id = (SELECT min(id) FROM jobs WHERE state = 'failed')"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    first = j.filter("state = 'failed'").agg(F.min("id")).first()[0]
    return plain(R.get_job(j, first).select("id", "state", "attempt", "created_at", "run_at", "finalized_at"))


@query("b04_state_counts", X.jobs_sql("SELECT d.state, d.ordinal, count(j.id) AS jobs FROM d LEFT JOIN jobs j USING (state) GROUP BY ALL", f"d(state, ordinal) AS (VALUES {STATE_LIST})"))
def _(spark, sf):
    return R.state_counts(X.jobs(spark, sf))


@query("b05_state_counts_unpivoted", X.jobs_sql("SELECT d.state, count(j.id) AS jobs FROM d LEFT JOIN jobs j USING (state) GROUP BY ALL", f"d(state, ordinal) AS (VALUES {STATE_LIST})"))
def _(spark, sf):
    return R.unpivot_counts(R.counts_by(X.jobs(spark, sf), "queue"))


OVERVIEW = f"""SELECT n.queue, any_value(d.display_name) AS display_name, any_value(d.owner) AS owner,
  coalesce(any_value(d.last_seen_at + to_seconds(greatest((d.sync_interval_ms // 1000) * 3, 30)) < :now), false) AS descriptor_stale,
  coalesce((SELECT count(DISTINCT hash) FROM hashes JOIN instances USING (instance_id) WHERE name = n.queue AND {LIVE_SQL}), 0) > 1 AS descriptor_mismatch,
  count(*) FILTER (WHERE j.state IN ('scheduled', 'available', 'retryable', 'running', 'waiting_external')) AS total_queued,
  {", ".join(f"count(*) FILTER (WHERE j.state = '{s}') AS {s}" for s in ["scheduled", "available", "retryable", "running", "failed", "waiting_external"])},
  count(*) FILTER (WHERE {RECENT}) AS completed_last_hour,
  CAST(date_diff('second', min(j.run_at) FILTER (WHERE j.state = 'available'), :now) AS DOUBLE) AS lag_seconds, coalesce(any_value(m.paused), false) AS paused
  FROM (SELECT queue FROM jobs UNION SELECT queue FROM queue_descriptors UNION SELECT queue FROM queue_meta UNION SELECT name FROM hashes) n
  LEFT JOIN jobs j ON j.queue = n.queue LEFT JOIN queue_descriptors d ON d.queue = n.queue LEFT JOIN queue_meta m ON m.queue = n.queue GROUP BY n.queue"""


def _overviews(spark, sf):
    return R.queue_overviews(X.jobs(spark, sf), X.as_of(), X.descriptors(spark), X.queue_meta(spark), X.instances(spark))


@query("b06_queue_overviews", X.jobs_sql(OVERVIEW, X.DESC, X.META, X.INST, X.HASHES))
def _(spark, sf):
    return _overviews(spark, sf)


@query("b07_queue_overview", X.jobs_sql(f"SELECT * FROM ({OVERVIEW}) WHERE queue = 'building'", X.DESC, X.META, X.INST, X.HASHES))
def _(spark, sf):
    return _overviews(spark, sf).filter("queue = 'building'")


@query("b08_state_timeseries", X.jobs_sql("SELECT date_trunc('minute', created_at)::VARCHAR AS bucket, state, count(*) AS jobs FROM jobs WHERE created_at >= :now - INTERVAL 180 MINUTE AND created_at <= :now GROUP BY ALL"))
def _(spark, sf):
    return plain(R.timeseries(X.jobs(spark, sf), X.as_of(), 180))


@query("b09_kind_overviews", X.jobs_sql(f"SELECT kind, count(*) AS job_count, count(DISTINCT queue) AS queue_count, count(*) FILTER (WHERE {RECENT}) AS completed_last_hour FROM jobs GROUP BY kind"))
def _(spark, sf):
    return R.kind_overviews(X.jobs(spark, sf), X.as_of())


@query("b10_kind_overviews_hot", X.jobs_sql(f"SELECT kind, count(*) AS job_count, count(DISTINCT queue) FILTER (WHERE state NOT IN ('scheduled', 'retryable')) AS queue_count, count(*) FILTER (WHERE {RECENT}) AS completed_last_hour FROM jobs GROUP BY kind"))
def _(spark, sf):
    return R.kind_overviews(X.jobs(spark, sf), X.as_of(), hot_queues_only=True)


@query("b11_kind_overview", X.jobs_sql(f"SELECT kind, count(*) AS job_count, count(DISTINCT queue) AS queue_count, count(*) FILTER (WHERE {RECENT}) AS completed_last_hour FROM jobs WHERE kind = 'charge_card' GROUP BY kind"))
def _(spark, sf):
    return R.kind_overviews(X.jobs(spark, sf), X.as_of()).filter("kind = 'charge_card'")


@query("b12_distinct_names", X.jobs_sql("SELECT DISTINCT 'kind' AS what, kind AS name FROM jobs UNION ALL SELECT DISTINCT 'queue', queue FROM jobs"))
def _(spark, sf):
    return R.distinct_names(X.jobs(spark, sf))


@query("b13_descriptors_for_names", f"WITH {X.DESC} SELECT queue, display_name, owner, sync_interval_ms, last_seen_at::VARCHAR AS last_seen_at FROM queue_descriptors WHERE queue IN ('building', 'archive', 'nowhere')")
def _(spark, sf):
    return plain(R.descriptors_for(X.descriptors(spark), ["building", "archive", "nowhere"]))


@query("b14_enriched_jobs", X.jobs_sql("SELECT j.id, j.queue, d.display_name, coalesce(first_priority, priority) AS original_priority FROM jobs j LEFT JOIN queue_descriptors d USING (queue) WHERE j.state = 'failed'", X.DESC))
def _(spark, sf):
    return R.enrich(X.jobs(spark, sf).filter("state = 'failed'"), X.descriptors(spark)).select("id", "queue", "display_name", "original_priority")


STALE = "epoch_us(:now) - epoch_us(last_seen_at) > 1000 * greatest(greatest(snapshot_interval_ms, 1000) * 3, 30000)"


@query("b15_runtime_instances", f"WITH {X.INST} SELECT instance_id, version, leader, {STALE} AS stale FROM instances".replace(":now", f"TIMESTAMP '{X.AS_OF}'"))
def _(spark, sf):
    return R.runtime_instances(X.instances(spark), X.as_of()).orderBy(F.desc("leader"), F.desc("last_seen_at")).select("instance_id", "version", "leader", "stale")


@query(
    "b16_runtime_overview",
    f"WITH {X.INST}, i AS (SELECT *, {STALE} AS stale FROM instances) SELECT count(*) AS total, count(*) FILTER (WHERE NOT stale) AS live, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE NOT stale AND healthy) AS healthy, count(*) FILTER (WHERE NOT stale AND leader) AS leaders FROM i".replace(":now", f"TIMESTAMP '{X.AS_OF}'"),
)
def _(spark, sf):
    return R.runtime_overview(X.instances(spark), X.as_of())


@query(
    "b17_queue_runtime_summary",
    f"""WITH {X.INST}, {X.INST_QUEUES}, i AS (SELECT *, {STALE} AS stale FROM instances JOIN inst_queues USING (instance_id))
    SELECT queue, count(*) AS instances, count(*) FILTER (WHERE NOT stale) AS live, CAST(sum(max_workers) FILTER (WHERE NOT stale) AS BIGINT) AS live_workers,
      count(DISTINCT max_workers) FILTER (WHERE NOT stale) <= 1 AND count(DISTINCT dlq) FILTER (WHERE NOT stale) <= 1 AS config_agrees,
      arg_min(max_workers, instance_id) FILTER (WHERE NOT stale) AS shown_workers FROM i GROUP BY queue""".replace(":now", f"TIMESTAMP '{X.AS_OF}'"),
)
def _(spark, sf):
    return R.queue_runtime_summary(X.instances(spark), X.as_of())


@query("b19_descriptor_drift", f"WITH {X.INST}, {X.HASHES} SELECT name, count(DISTINCT hash) AS variants FROM hashes JOIN instances USING (instance_id) WHERE {LIVE_SQL} GROUP BY name".replace(":now", f"TIMESTAMP '{X.AS_OF}'"))
def _(spark, sf):
    return R.descriptor_drift(X.instances(spark), X.as_of())


@query("b20_list_dlq", X.jobs_sql("SELECT id, queue, dlq_reason, dlq_at::VARCHAR AS dlq_at FROM dlq WHERE (dlq_at, id) < (TIMESTAMP '2024-01-05 00:00:00', 30000) ORDER BY dlq.dlq_at DESC, id DESC LIMIT 50", DLQ))
def _(spark, sf):
    return plain(R.dlq_list(_dlq(spark, sf), 50, before=("2024-01-05 00:00:00", 30_000)).select("id", "queue", "dlq_reason", "dlq_at"))


@query("b20_list_dlq_by_id", X.jobs_sql("SELECT id, queue, dlq_at::VARCHAR AS dlq_at FROM dlq WHERE id < 30000 AND queue = 'building' ORDER BY dlq.dlq_at DESC, id DESC LIMIT 50", DLQ))
def _(spark, sf):
    return plain(R.dlq_list(_dlq(spark, sf), 50, before_id=30_000, queue="building").select("id", "queue", "dlq_at"))


@query("b21_dlq_job", X.jobs_sql("SELECT id, dlq_reason, dlq_at::VARCHAR AS dlq_at FROM dlq WHERE id = 11 ORDER BY dlq.dlq_at DESC LIMIT 1", DLQ))
def _(spark, sf):
    return plain(R.dlq_latest(_dlq(spark, sf), 11).select("id", "dlq_reason", "dlq_at"))


@query("b22_dlq_depth", X.jobs_sql("SELECT count(*) AS depth FROM dlq WHERE queue = 'household'", DLQ))
def _(spark, sf):
    return R.dlq_depth(_dlq(spark, sf), "household")


@query("b23_dlq_depth_by_queue", X.jobs_sql("SELECT queue, count(*) AS depth FROM dlq GROUP BY queue", DLQ))
def _(spark, sf):
    return R.dlq_depth_by_queue(_dlq(spark, sf)).orderBy(F.desc("depth"), "queue")


ERRORS = "errs AS (SELECT id, i, attempt - i AS attempt, 'boom ' || (id % 9) AS error, run_at - to_minutes(i) AS err_at, id % 5 = 0 AND i = 0 AS terminal, n_errors - i AS place FROM jobs, range(2) r(i) WHERE i < n_errors)"


@query(
    "b25_timeline",
    X.jobs_sql(
        """SELECT id, event, ts::VARCHAR AS ts, detail, row_number() OVER (PARTITION BY id ORDER BY e.ts, n)::INTEGER AS position FROM (
        SELECT id, 0 AS n, 'created' AS event, created_at AS ts, NULL AS detail FROM jobs UNION ALL SELECT id, 1, 'due', run_at, NULL FROM jobs
        UNION ALL SELECT id, 2, 'attempted', attempted_at, NULL FROM jobs UNION ALL SELECT id, 2 + place, 'error', err_at, error FROM errs
        UNION ALL SELECT id, 1000, 'finalized', finalized_at, state FROM jobs) e WHERE e.ts IS NOT NULL""",
        ERRORS,
    ),
)
def _(spark, sf):
    return plain(R.timeline(X.jobs(spark, sf)))


@query(
    "b26_summary",
    X.jobs_sql("SELECT id, state IN ('failed', 'cancelled', 'waiting_external') AS can_retry, state NOT IN ('completed', 'failed', 'cancelled') AS can_cancel, n_errors::BIGINT AS error_count, CASE WHEN n_errors > 0 THEN 'boom ' || (id % 9) END AS latest_error FROM jobs"),
)
def _(spark, sf):
    return R.summary(X.jobs(spark, sf))


@query(
    "b27_dump_run",
    X.jobs_sql(
        """SELECT j.id, 1 AS attempt, CASE WHEN j.attempt = 1 THEN j.state WHEN e.id IS NULL THEN 'unknown' WHEN e.terminal THEN 'failed' ELSE 'retryable' END AS outcome,
        CASE WHEN j.attempt = 1 THEN CASE WHEN n_errors > 0 THEN 'boom ' || (j.id % 9) END ELSE e.error END AS error
        FROM jobs j LEFT JOIN errs e ON e.id = j.id AND e.attempt = 1 WHERE j.attempt >= 1""",
        ERRORS,
    ),
)
def _(spark, sf):
    return R.dump_run(X.jobs(spark, sf), 1)


@query(
    "b24_dump_job",
    X.jobs_sql(
        """SELECT j.id, kind, queue, state, coalesce(first_priority, priority) AS original_priority, state IN ('failed', 'cancelled', 'waiting_external') AS can_retry,
        state NOT IN ('completed', 'failed', 'cancelled') AS can_cancel, n_errors::BIGINT AS error_count, CASE WHEN n_errors > 0 THEN 'boom ' || (j.id % 9) END AS latest_error, timeline
        FROM jobs j JOIN (SELECT id, string_agg(event || ' ' || ts::VARCHAR || coalesce(' ' || detail, ''), '; ' ORDER BY ts, n) AS timeline FROM (
        SELECT id, 0 AS n, 'created' AS event, created_at AS ts, NULL AS detail FROM jobs UNION ALL SELECT id, 1, 'due', run_at, NULL FROM jobs
        UNION ALL SELECT id, 2, 'attempted', attempted_at, NULL FROM jobs UNION ALL SELECT id, 2 + place, 'error', err_at, error FROM errs
        UNION ALL SELECT id, 1000, 'finalized', finalized_at, state FROM jobs) WHERE ts IS NOT NULL GROUP BY id) t ON t.id = j.id""",
        ERRORS,
    ),
)
def _(spark, sf):
    text = F.array_join(F.transform("timeline", lambda e: F.concat_ws(" ", e["event"], e["ts"].cast("string"), e["detail"])), "; ")
    return R.dump_job(X.jobs(spark, sf)).withColumn("timeline", text)


@query("b28_runtime_overrides", f"WITH {X.META} SELECT queue, completed_retention_s, failed_retention_s FROM queue_meta WHERE queue = 'furniture'")
def _(spark, sf):
    return X.queue_meta(spark).filter("queue = 'furniture'").select("queue", "completed_retention_s", "failed_retention_s")


@query("b29_unique_candidates", X.jobs_sql("SELECT unique_key, min(id) AS id FROM jobs WHERE unique_key IS NOT NULL AND state NOT IN ('completed', 'failed', 'cancelled') GROUP BY unique_key"))
def _(spark, sf):
    return R.unique_candidate(X.jobs(spark, sf))


@query("b30_batch_preview", X.jobs_sql("SELECT (SELECT count(*) FROM m) AS matched, (SELECT max(id) FROM m) AS max_id, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM m ORDER BY id LIMIT 10)) AS sample", "m AS (SELECT * FROM jobs WHERE state IN ('failed', 'cancelled') AND kind = 'send_email')"))
def _(spark, sf):
    return plain(R.batch_preview(X.jobs(spark, sf), states=["failed", "cancelled"], kind="send_email"))


@query("b31_batch_page", X.jobs_sql("SELECT id FROM jobs WHERE state = 'failed' AND queue = 'machinery' AND id > 5000 AND id <= 50000 ORDER BY id LIMIT 100"))
def _(spark, sf):
    return X.jobs(spark, sf).filter(R.job_filter(states="failed", queue="machinery", after_id=5000, max_id=50_000)).orderBy("id").limit(100).select("id")


@query("b32_batch_page_rebuilt", X.jobs_sql("SELECT id, state FROM jobs WHERE state IN ('available', 'retryable') AND list_contains(tags, 'seg-1')"))
def _(spark, sf):
    return X.jobs(spark, sf).filter(R.job_filter(states=["available", "retryable"], tag="seg-1")).select("id", "state")


@query("b33_filter_predicate", X.jobs_sql("SELECT id, state = 'failed' AND list_contains(tags, 'seg-2') AND finalized_at < TIMESTAMP '2024-01-04 00:00:00' AND id > 100 AS matches FROM jobs WHERE state IN ('failed', 'cancelled')"))
def _(spark, sf):
    return X.jobs(spark, sf).filter("state IN ('failed', 'cancelled')").select("id", R.job_filter(states="failed", tag="seg-2", finalized_before=F.lit("2024-01-04 00:00:00").cast("timestamp_ntz"), after_id=100).alias("matches"))


GAUGES = ["scheduled", "available", "running", "retryable", "waiting_external", "failed"]


@query(
    "b36_queue_health",
    X.jobs_sql(
        " UNION ALL ".join(f"SELECT queue, '{g}' AS gauge, CAST(count(*) FILTER (WHERE state = '{g}') AS DOUBLE) AS value FROM jobs GROUP BY queue" for g in GAUGES)
        + " UNION ALL SELECT queue, 'lag_seconds', CAST(date_diff('second', min(run_at), :now) AS DOUBLE) FROM jobs WHERE state = 'available' GROUP BY queue"
    ),
)
def _(spark, sf):
    return R.queue_health(X.jobs(spark, sf), X.as_of())


@query("b38_backlog", X.jobs_sql("SELECT count(*) AS backlog FROM jobs WHERE state NOT IN ('completed', 'failed', 'cancelled')"))
def _(spark, sf):
    return R.backlog(X.jobs(spark, sf))


RANK = "split_part(version, '.', 1)::BIGINT * 1000000 + coalesce(nullif(split_part(version, '.', 2), '')::BIGINT, 0) * 1000 + coalesce(nullif(split_part(version, '.', 3), '')::BIGINT, 0)"


@query(
    "b39_storage_report",
    X.jobs_sql(
        f"""SELECT b AS backlog, live, old, concat_ws('; ', CASE WHEN b > 0 THEN b || ' jobs are not terminal' END, CASE WHEN old > 0 THEN old || ' live instances are older than 1.1.0' END) AS blockers
        FROM (SELECT count(*) AS b FROM jobs WHERE state NOT IN ('completed', 'failed', 'cancelled')), (SELECT count(*) AS live, count(*) FILTER (WHERE {RANK} < 1001000) AS old FROM instances WHERE {LIVE_SQL})""",
        X.INST,
    ),
)
def _(spark, sf):
    return R.storage_report(X.jobs(spark, sf), X.instances(spark), X.as_of())


@query("b40_cluster_probe", f"WITH {X.INST} SELECT count(*) FILTER (WHERE last_seen_at + INTERVAL 90 SECOND >= t) AS live, count(*) FILTER (WHERE last_seen_at + INTERVAL 90 SECOND >= t AND NOT healthy) AS unhealthy FROM instances, (SELECT TIMESTAMP '{X.AS_OF}' AS t)")
def _(spark, sf):
    return R.cluster_probe(X.instances(spark), X.as_of())


@query("b41_ring_authority", f"WITH {X.INST} SELECT count(*) AS fresh, count(*) FILTER (WHERE {RANK} >= 1002000) AS aware, count(*) FILTER (WHERE NOT coalesce({RANK} >= 1002000, false)) AS blocking FROM instances WHERE {LIVE_SQL}".replace(":now", f"TIMESTAMP '{X.AS_OF}'"))
def _(spark, sf):
    return R.ring_authority(X.instances(spark), X.as_of(), "1.2.0")


LAG = "SELECT queue, CAST(date_diff('second', min(run_at), :now) AS DOUBLE) AS lag_seconds FROM jobs WHERE state = 'available' GROUP BY queue"


@query("b42_alert_lag", X.jobs_sql(f"SELECT * FROM ({LAG}) WHERE lag_seconds > 300"))
def _(spark, sf):
    return R.lag_by_queue(X.jobs(spark, sf), X.as_of(), over_s=300)


@query("b43_alert_error_ratio", X.jobs_sql("SELECT queue, count(*) FILTER (WHERE state = 'failed') / greatest(count(*) FILTER (WHERE state IN ('completed', 'failed')), 1) AS error_ratio FROM jobs WHERE finalized_at > :now - INTERVAL 60 MINUTE AND finalized_at <= :now GROUP BY queue"))
def _(spark, sf):
    return R.error_ratio(X.jobs(spark, sf), X.as_of(), 60)


@query("b44_live_runtimes", f"WITH {X.INST} SELECT count(*) AS live FROM instances WHERE {LIVE_SQL}".replace(":now", f"TIMESTAMP '{X.AS_OF}'"))
def _(spark, sf):
    return R.live_instances(X.instances(spark), X.as_of()).agg(F.count("*").alias("live"))


@query(
    "b46_dashboard_totals",
    X.jobs_sql("SELECT count(*) FILTER (WHERE state NOT IN ('completed', 'failed', 'cancelled')) AS backlog, count(*) FILTER (WHERE state = 'completed' AND finalized_at > :now - INTERVAL 1 MINUTE AND finalized_at <= :now) AS completed_last_minute, count(*) FILTER (WHERE state = 'failed' AND finalized_at > :now - INTERVAL 1 HOUR AND finalized_at <= :now) AS failed_last_hour, (SELECT count(*) FROM queue_meta WHERE paused) AS paused_queues FROM jobs", X.META),
)
def _(spark, sf):
    return R.dashboard(X.jobs(spark, sf), X.queue_meta(spark), X.as_of())


@query("b45_queue_backlog", X.jobs_sql("SELECT queue, count(*) AS backlog FROM jobs WHERE state NOT IN ('completed', 'failed', 'cancelled') GROUP BY queue"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    return j.filter(~F.col("state").isin("completed", "failed", "cancelled")).groupBy("queue").agg(F.count("*").alias("backlog"))


@query("b47_top_lag", X.jobs_sql(f"{LAG} ORDER BY lag_seconds DESC NULLS LAST, queue LIMIT 3"))
def _(spark, sf):
    return R.lag_by_queue(X.jobs(spark, sf), X.as_of(), top=3)


@query("b48_throughput", X.jobs_sql("SELECT date_trunc('minute', finalized_at)::VARCHAR AS bucket, queue || ' · ' || state AS series, count(*) AS jobs FROM jobs WHERE finalized_at > :now - INTERVAL 240 MINUTE AND finalized_at <= :now GROUP BY ALL"))
def _(spark, sf):
    return plain(R.throughput(X.jobs(spark, sf), X.as_of(), 240))


@query("b49_drift_table", f"WITH {X.INST}, {X.HASHES} SELECT name AS queue, count(DISTINCT hash) AS variants, CASE WHEN count(DISTINCT hash) > 1 THEN 'drift' ELSE 'same' END AS verdict FROM hashes JOIN instances USING (instance_id) WHERE {LIVE_SQL} GROUP BY name".replace(":now", f"TIMESTAMP '{X.AS_OF}'"))
def _(spark, sf):
    d = R.descriptor_drift(X.instances(spark), X.as_of())
    return d.select(F.col("name").alias("queue"), "variants", F.when(F.col("variants") > 1, "drift").otherwise("same").alias("verdict"))


@query("b50_queue_stats", X.jobs_sql("SELECT queue, state, count(*) AS n, (min(run_at) FILTER (WHERE state = 'available'))::VARCHAR AS oldest FROM jobs GROUP BY queue, state"))
def _(spark, sf):
    return plain(X.jobs(spark, sf).groupBy("queue", "state").agg(F.count("*").alias("n"), F.min(F.when(F.col("state") == "available", F.col("run_at"))).alias("oldest")))


@query(
    "b51_counts_with_rollups",
    X.jobs_sql("SELECT queue, kind, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM (SELECT queue, kind, count(*) AS n FROM jobs WHERE state = 'completed' AND id % 3 > 0 GROUP BY ALL) a FULL JOIN (SELECT queue, kind, count(*) AS n FROM jobs WHERE state = 'failed' AND id % 8 <> 4 GROUP BY ALL) b USING (queue, kind)"),
)
def _(spark, sf):
    j = X.jobs(spark, sf)
    count = lambda cond: j.filter(cond).groupBy("queue", "kind").agg(F.count("*").alias("n"))
    return R.merged_counts(count("state = 'completed' AND id % 3 > 0"), count("state = 'failed' AND id % 8 <> 4"), ["queue", "kind"])


@query("b52_repeated_scan", X.jobs_sql("SELECT max(n) AS most FROM range(5), (SELECT count(*) AS n FROM jobs WHERE state = 'available')"))
def _(spark, sf):
    n = X.jobs(spark, sf).filter("state = 'available'").agg(F.count("*").alias("n"))
    return spark.range(5).crossJoin(n).agg(F.max("n").alias("most"))


@query("b53_counts_sample", X.jobs_sql(f"SELECT {', '.join(f'''count(*) FILTER (WHERE state = '{s}') AS {s}''' for s in STATES)} FROM jobs"))
def _(spark, sf):
    return R.counts_by(X.jobs(spark, sf))


@query(
    "b54_latency_percentiles",
    X.jobs_sql(
        """SELECT queue, l[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS by_floor, l[floor((n - 1) * 0.95 + 0.5)::BIGINT + 1] AS by_round, q AS interpolated
        FROM (SELECT queue, list(v ORDER BY v) AS l, count(*) AS n, quantile_cont(v, 0.95) AS q FROM (SELECT queue, CAST(date_diff('second', run_at, finalized_at) AS DOUBLE) AS v FROM jobs WHERE state = 'completed') GROUP BY queue)"""
    ),
)
def _(spark, sf):
    j = X.jobs(spark, sf).filter("state = 'completed'").select("queue", F.timestamp_diff("SECOND", "run_at", "finalized_at").cast("double").alias("v"))
    return R.percentiles(j, "v", 0.95, "queue")
