"""Registered transition queries: the new snapshot's changed rows, or its counts, against SQL over the old one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transitions as T
from ..registry import query
from ..sources import fixtures as X
from .common import plain

NOW = "2024-01-07 12:00:00"
SHOW = ("id", "state", "attempt", "run_at", "finalized_at")


def _changed(df, *columns):
    return plain(df.filter("changed").select(*columns))


def _errors(df):
    return df.withColumn("n_errors", F.size("errors").cast("long")).withColumn("last_error", F.try_element_at("errors", F.lit(-1))["error"])


@query(
    "t01_claim",
    X.jobs_sql(
        """SELECT id, 'running' AS state, attempt + 1 AS attempt, run_lease + 1 AS run_lease, (:now + INTERVAL 300 SECOND)::VARCHAR AS deadline_at FROM (
        SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority, run_at, id) AS n FROM jobs WHERE state = 'available' AND run_at <= :now AND queue NOT IN (SELECT queue FROM queue_meta WHERE paused)) WHERE n <= 50""",
        X.META,
    ),
)
def _(spark, sf):
    return _changed(T.claim(X.jobs(spark, sf), X.queue_meta(spark), X.as_of(), 50), "id", "state", "attempt", "run_lease", "deadline_at")


LIVE = "live AS (SELECT l.* FROM lanes l JOIN (SELECT queue, priority, enqueue_shard, count(*) * 7 // 10 + 1 AS head FROM lanes GROUP BY ALL) h USING (queue, priority, enqueue_shard) WHERE lane_seq >= head AND run_at <= :now AND state = 'available')"


@query(
    "t02_claim_lane",
    X.jobs_sql(
        """SELECT l.id, l.queue, l.priority, b.effective::INTEGER AS effective, row_number() OVER (PARTITION BY l.queue ORDER BY l.lane_seq)::INTEGER AS ordinal FROM live l JOIN (
        SELECT *, greatest(1, priority - date_diff('second', first_run, :now) // 86400) AS effective,
          row_number() OVER (PARTITION BY queue ORDER BY greatest(1, priority - date_diff('second', first_run, :now) // 86400), first_run, priority, enqueue_shard) AS n
        FROM (SELECT queue, priority, enqueue_shard, arg_min(run_at, lane_seq) AS first_run FROM live GROUP BY ALL)) b USING (queue, priority, enqueue_shard) WHERE b.n = 1
        QUALIFY row_number() OVER (PARTITION BY l.queue ORDER BY l.lane_seq) <= 20""",
        X.LANES,
        LIVE,
    ),
)
def _(spark, sf):
    l = X.lanes(spark, sf)
    lane = ["queue", "priority", "enqueue_shard"]
    heads = l.groupBy(*lane).agg((F.floor(F.count("*") * 7 / 10) + 1).cast("long").alias("next_claim_seq"))
    spent = l.filter("state <> 'available'").select(*lane, "lane_seq")
    ready = l.select("id", *lane, "lane_seq", "run_at")
    return T.claim_lane(ready, heads, spent, X.as_of(), 86_400, 20).select("id", "queue", "priority", "effective", "ordinal")


@query("t06_complete", X.jobs_sql("SELECT id, 'completed' AS state, :now::VARCHAR AS finalized_at FROM jobs WHERE state = 'running' AND id % 5 <> 0"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    asked = j.select("id", (F.col("run_lease") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("run_lease"))  # a fifth is stale
    return _changed(T.complete(j, asked, X.as_of()), "id", "state", "finalized_at")


def _requests(j):
    action = F.when(F.col("id") % 3 == 0, "snooze").when(F.col("id") % 3 == 1, "retry_after").otherwise("retry_backoff")
    return j.filter("state = 'running'").select("id", "run_lease", action.alias("action"), F.lit(90.75).alias("delay_s"), F.lit("nope").alias("error"), ((F.col("id") % 8) / 8).alias("u"))


RUN = "run AS (SELECT *, CASE WHEN k3 = 0 THEN 'scheduled' WHEN attempt >= cap THEN 'failed' ELSE 'retryable' END AS new_state FROM (SELECT *, id % 3 AS k3, CASE WHEN id % 7 = 0 THEN 1 ELSE 5 END AS cap FROM jobs WHERE state = 'running'))"


@query(
    "t08_reschedule",
    X.jobs_sql(
        """SELECT id, new_state AS state, CASE WHEN k3 = 0 THEN greatest(attempt - 1, 0) ELSE attempt END AS attempt,
        (CASE WHEN new_state = 'failed' THEN run_at WHEN k3 = 2 THEN :now + to_seconds(floor(least(pow(2, attempt) * (1 + 0.25 * ((id % 8) / 8)), 86400))::BIGINT) ELSE :now + INTERVAL 90 SECOND END)::VARCHAR AS run_at,
        CASE WHEN k3 > 0 THEN :now::VARCHAR END AS finalized_at, (CASE WHEN new_state = 'failed' OR k3 = 2 THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM run""",
        RUN,
    ),
)
def _(spark, sf):
    j = X.jobs(spark, sf).withColumn("max_attempts", F.when(F.col("id") % 7 == 0, 1).otherwise(5))
    return _changed(_errors(T.reschedule(j, _requests(j), X.as_of())), *SHOW, "n_errors")


@query(
    "t11_outcomes",
    X.jobs_sql(
        """SELECT id, CASE r WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'waiting_external' WHEN 3 THEN 'failed' WHEN 4 THEN 'retryable' WHEN 5 THEN 'retryable' ELSE 'scheduled' END AS state,
        CASE WHEN r = 6 THEN greatest(attempt - 1, 0) ELSE attempt END AS attempt, (CASE r WHEN 4 THEN :now + to_seconds(floor(pow(2, attempt))::BIGINT) WHEN 5 THEN :now + INTERVAL 30 SECOND WHEN 6 THEN :now + INTERVAL 30 SECOND ELSE run_at END)::VARCHAR AS run_at,
        CASE WHEN r NOT IN (2, 6) THEN :now::VARCHAR END AS finalized_at, (CASE WHEN r IN (3, 4) THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM (SELECT *, (id // 16) % 7 AS r FROM jobs WHERE state = 'running')"""
    ),
)
def _(spark, sf):
    j = X.jobs(spark, sf)
    names = F.array(*map(F.lit, ["completed", "cancel", "wait", "terminal", "retryable", "retry_after", "snooze"]))
    asked = j.filter("state = 'running'").select("id", "run_lease", F.element_at(names, (F.floor(F.col("id") / 16) % 7 + 1).cast("int")).alias("result"), F.lit(30.9).alias("delay_s"), F.lit("e").alias("error"))
    return _changed(_errors(T.outcomes(j, asked, X.as_of())), *SHOW, "n_errors")


RETRYABLE = "state IN ('failed', 'cancelled', 'waiting_external')"


@query("t12_retry", X.jobs_sql(f"SELECT id, 'available' AS state, 0 AS attempt, :now::VARCHAR AS run_at, NULL AS finalized_at FROM jobs WHERE id % 13 = 1 AND {RETRYABLE}"))
def _(spark, sf):
    return _changed(T.retry(X.jobs(spark, sf), F.col("id") % 13 == 1, X.as_of()), *SHOW)


@query("t13_cancel", X.jobs_sql("SELECT id, 'cancelled' AS state, state IN ('running', 'waiting_external') AS notify FROM jobs WHERE id % 9 = 2 AND state NOT IN ('completed', 'failed', 'cancelled')"))
def _(spark, sf):
    return _changed(T.cancel(X.jobs(spark, sf), F.col("id") % 9 == 2, X.as_of()), "id", "state", "notify")


@query("t14_cancel_unique", X.jobs_sql("SELECT id, 'cancelled' AS state FROM (SELECT min(id) AS id FROM jobs WHERE unique_key = (SELECT min(unique_key) FROM jobs WHERE state = 'retryable') AND state NOT IN ('completed', 'failed', 'cancelled'))"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    key = j.filter("state = 'retryable'").agg(F.min("unique_key")).first()[0]
    return _changed(T.cancel_unique(j, key, X.as_of()), "id", "state")


@query("t15_retry_failed", X.jobs_sql("SELECT id, 'available' AS state FROM jobs WHERE kind = 'charge_card' AND state = 'failed'"))
def _(spark, sf):
    return _changed(T.retry(X.jobs(spark, sf), (F.col("kind") == "charge_card") & (F.col("state") == "failed"), X.as_of()), "id", "state")


@query("t16_discard_failed", X.jobs_sql("SELECT state, count(*) AS n FROM jobs WHERE NOT (kind = 'render_invoice' AND state = 'failed') GROUP BY state"))
def _(spark, sf):
    return T.discard_failed(X.jobs(spark, sf), "render_invoice").groupBy("state").agg(F.count("*").alias("n"))


@query("t17_bulk_cancel", X.jobs_sql("SELECT id FROM jobs WHERE id IN (6, 7, 8, 9, 10, 11, 22, 23, 25, 26) AND state NOT IN ('completed', 'failed', 'cancelled')"))
def _(spark, sf):
    return _changed(T.cancel(X.jobs(spark, sf), F.col("id").isin(6, 7, 8, 9, 10, 11, 22, 23, 25, 26), X.as_of()), "id")


@query("t18_drain_queue", X.jobs_sql("SELECT id, 'cancelled' AS state FROM jobs WHERE queue = 'household' AND state IN ('available', 'scheduled', 'retryable', 'waiting_external')"))
def _(spark, sf):
    return _changed(T.drain(X.jobs(spark, sf), "household", X.as_of()), "id", "state")


@query("t19_pause", f"WITH {X.META} SELECT queue, coalesce(bool_or(p), bool_or(paused)) AS paused FROM (SELECT queue, paused, NULL::BOOLEAN AS p FROM queue_meta UNION ALL SELECT * FROM (VALUES ('building', NULL, true), ('new', NULL, true)) v(queue, paused, p)) GROUP BY queue")
def _(spark, sf):
    return T.set_paused(X.queue_meta(spark), ["building", "new"], True).select("queue", "paused")


@query("t20_overrides", f"WITH {X.META} SELECT queue, paused, CASE WHEN queue = 'building' THEN 60 ELSE completed_retention_s END AS completed_retention_s FROM queue_meta")
def _(spark, sf):
    rows = spark.createDataFrame([("building", 60)], "queue string, completed_retention_s int")
    return T.upsert(X.queue_meta(spark), rows, "queue").select("queue", "paused", "completed_retention_s")


@query(
    "t21_sync_descriptors",
    f"""WITH old(queue, hash, t) AS (VALUES ('a', 'h1', '2024-01-01 00:00:00'), ('b', 'h1', '2024-01-01 00:00:00'), ('c', 'h1', '2024-01-01 00:00:00')), new(queue, hash) AS (VALUES ('a', 'h1'), ('b', 'h2'), ('d', 'h4'))
    SELECT coalesce(o.queue, n.queue) AS queue, coalesce(n.hash, o.hash) AS hash, CASE WHEN n.hash IS NULL OR n.hash = o.hash THEN o.t ELSE '{NOW}' END AS updated_at, CASE WHEN n.queue IS NULL THEN o.t ELSE '{NOW}' END AS last_seen_at FROM old o FULL JOIN new n ON o.queue = n.queue""",
)
def _(spark, sf):
    old = spark.createDataFrame([(q, "h1") for q in "abc"], "queue string, hash string").withColumns({c: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") for c in ("updated_at", "last_seen_at")})
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", "h4")], "queue string, hash string")
    return plain(T.sync_descriptors(old, new, X.as_of()))


@query("t22_newest_snapshot", "SELECT user_id AS user_id, max(event_id)::BIGINT AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, sf):
    e = X.table(spark, sf, "events").select("user_id", F.col("event_id").cast("long").alias("event_id"), "event_type")
    return T.newest(e, "user_id", "event_id")


@query("t24_unique_claims", X.jobs_sql("SELECT unique_key, min(id) AS holder, count(*) AS wanting FROM jobs WHERE unique_key IS NOT NULL AND unique_states IS NOT NULL AND state IN ('scheduled', 'available', 'running', 'completed', 'retryable') GROUP BY unique_key"))
def _(spark, sf):
    return T.claims(X.jobs(spark, sf))


@query(
    "t25_enforce_unique",
    X.jobs_sql(
        """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY unique_key ORDER BY id) AS n FROM fresh WHERE wants) WHERE n = 1 AND unique_key NOT IN (SELECT unique_key FROM old WHERE unique_key IS NOT NULL AND unique_states IS NOT NULL AND state IN ('scheduled', 'available', 'running', 'completed', 'retryable'))
        UNION ALL SELECT id FROM fresh WHERE NOT wants""",
        "fresh AS (SELECT *, unique_key IS NOT NULL AND unique_states IS NOT NULL AND state IN ('scheduled', 'available', 'running', 'completed', 'retryable') AS wants FROM jobs WHERE id % 4 = 2)",
        "old AS (SELECT * FROM jobs WHERE id % 4 <> 2 AND id % 3 = 0)",
    ),
)
def _(spark, sf):
    j = X.jobs(spark, sf)
    return T.enforce_unique(j.filter("id % 4 = 2"), j.filter("id % 4 <> 2 AND id % 3 = 0"), "id").select("id")


@query(
    "t26_promote",
    X.jobs_sql("SELECT id, 'available' AS state, attempt, :now::VARCHAR AS run_at FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY run_at, id) AS n FROM jobs WHERE state IN ('scheduled', 'retryable') AND run_at <= :now) WHERE n <= 500"),
)
def _(spark, sf):
    return _changed(T.promote(X.jobs(spark, sf), X.as_of(), 500), "id", "state", "attempt", "run_at")


@query(
    "t27_age_priorities",
    X.jobs_sql("SELECT id, priority - 1 AS priority, coalesce(first_priority, priority) AS first_priority FROM jobs WHERE state = 'available' AND priority > 1 AND run_at <= :now - INTERVAL 60 SECOND ORDER BY run_at, id LIMIT 1000"),
)
def _(spark, sf):
    a = T.age_priorities(X.jobs(spark, sf), X.as_of(), 60)
    return a.filter("changed").select("id", "priority", F.get_json_object("metadata", "$.original_priority").cast("int").alias("first_priority"))


def _rescued(cond: str, key: str, error: str) -> str:
    return X.jobs_sql(f"SELECT id, 'retryable' AS state, attempt, run_at::VARCHAR AS run_at, :now::VARCHAR AS finalized_at, '{error}' AS last_error FROM jobs WHERE state = 'running' AND {cond} ORDER BY {key}, id LIMIT 300")


@query("t28_rescue_stale", _rescued("heartbeat_at < :now - INTERVAL 90 SECOND", "heartbeat_at", "heartbeat stale"))
def _(spark, sf):
    return _changed(_errors(T.rescue_stale(X.jobs(spark, sf), X.as_of(), batch=300)), *SHOW, "last_error")


@query("t29_rescue_overdue", _rescued("deadline_at < :now", "deadline_at", "deadline exceeded"))
def _(spark, sf):
    return _changed(_errors(T.rescue_overdue(X.jobs(spark, sf), X.as_of(), batch=300)), *SHOW, "last_error")


@query(
    "t30_rescue_callbacks",
    X.jobs_sql(
        """SELECT id, CASE WHEN attempt >= 3 THEN 'failed' ELSE 'retryable' END AS state, attempt, (CASE WHEN attempt >= 3 THEN run_at ELSE :now + to_seconds(floor(pow(2, attempt) * 1.125)::BIGINT) END)::VARCHAR AS run_at, :now::VARCHAR AS finalized_at, NULL AS callback_id
        FROM jobs WHERE state = 'waiting_external' AND callback_timeout_at < :now ORDER BY jobs.callback_timeout_at, id LIMIT 500"""
    ),
)
def _(spark, sf):
    j = X.jobs(spark, sf).withColumn("max_attempts", F.lit(3))
    return _changed(T.rescue_callbacks(j, X.as_of(), F.lit(0.5)), *SHOW, "callback_id")


@query(
    "t31_rescue_conflicts",
    X.jobs_sql(
        """SELECT id, CASE WHEN wants AND (held OR n > 1) THEN 'cancelled' ELSE 'available' END AS state FROM (
        SELECT id, wants, unique_key IN (SELECT unique_key FROM jobs WHERE NOT hit(id, state) AND unique_key IS NOT NULL AND unique_states IS NOT NULL AND state IN ('scheduled', 'available', 'running', 'completed', 'retryable')) AS held,
          row_number() OVER (PARTITION BY unique_key, wants ORDER BY id) AS n FROM (SELECT *, unique_key IS NOT NULL AND unique_states IS NOT NULL AS wants FROM jobs WHERE hit(id, state)))"""
    ).replace("hit(id, state)", "(id % 2 = 0 AND state IN ('failed', 'cancelled', 'waiting_external'))"),
)
def _(spark, sf):
    j = X.jobs(spark, sf)
    after = T.retry(j, F.col("id") % 2 == 0, X.as_of())
    return _changed(T.settle_conflicts(j, after, X.as_of()), "id", "state")


KEEP = "state NOT IN ('completed', 'failed', 'cancelled') OR NOT finalized_at < :now - to_seconds(CASE WHEN state = 'completed' THEN coalesce(completed_retention_s, 86400) ELSE coalesce(failed_retention_s, 259200) END)"


@query("t32_retention", X.jobs_sql(f"SELECT queue, state, count(*) AS n FROM jobs LEFT JOIN queue_meta USING (queue) WHERE {KEEP} GROUP BY ALL", X.META))
def _(spark, sf):
    return T.retain(X.jobs(spark, sf), X.queue_meta(spark), X.as_of()).groupBy("queue", "state").agg(F.count("*").alias("n"))


@query("t32_retention_batch", X.jobs_sql(f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM jobs WHERE id NOT IN (SELECT id FROM jobs LEFT JOIN queue_meta USING (queue) WHERE NOT ({KEEP}) ORDER BY finalized_at, id LIMIT 700)", X.META))
def _(spark, sf):
    return T.retain(X.jobs(spark, sf), X.queue_meta(spark), X.as_of(), batch=700).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("t33_dlq_retention", X.jobs_sql("SELECT id FROM jobs WHERE state = 'failed' AND NOT finalized_at < :now - CASE WHEN queue = 'building' THEN INTERVAL 1 DAY ELSE INTERVAL 3 DAY END"))
def _(spark, sf):
    letters = X.jobs(spark, sf).filter("state = 'failed'").withColumn("dlq_at", F.col("finalized_at"))
    overrides = spark.createDataFrame([("building", 86_400)], "queue string, dlq_retention_s int")
    return T.retain_dlq(letters, X.as_of(), overrides, 3 * 86_400).select("id")


@query("t34_move_to_dlq", X.jobs_sql("SELECT id, 'operator' AS dlq_reason, :now::VARCHAR AS dlq_at, run_lease AS original_run_lease FROM jobs WHERE state = 'failed' AND queue = 'furniture'"))
def _(spark, sf):
    return plain(T.move_to_dlq(X.jobs(spark, sf), X.as_of(), queue="furniture")[1].select("id", "dlq_reason", "dlq_at", "original_run_lease"))


@query(
    "t35_retry_from_dlq",
    X.jobs_sql(
        """SELECT id, 'available' AS state, 0 AS attempt, 0::BIGINT AS run_lease FROM (SELECT *, row_number() OVER (PARTITION BY unique_key ORDER BY id) AS n FROM jobs WHERE state = 'failed' AND kind = 'sync_inventory')
        WHERE (unique_key IS NULL OR n = 1) AND coalesce(unique_key NOT IN (SELECT unique_key FROM jobs WHERE state IN ('scheduled', 'available', 'running', 'completed', 'retryable') AND unique_key IS NOT NULL AND unique_states IS NOT NULL), true)"""
    ),
)
def _(spark, sf):
    rest, letters = T.move_to_dlq(X.jobs(spark, sf), X.as_of(), allow_all=True)
    # the first letter of a key is taken among those whose claim is free
    return T.retry_from_dlq(letters, rest, F.col("kind") == "sync_inventory", X.as_of())[1].select("id", "state", "attempt", "run_lease")


@query("t36_purge_dlq", X.jobs_sql("SELECT kind, count(*) AS n FROM jobs WHERE state = 'failed' AND NOT (kind = 'charge_card' AND queue = 'machinery') GROUP BY kind"))
def _(spark, sf):
    letters = X.jobs(spark, sf).filter("state = 'failed'")
    return T.purge_dlq(letters, kind="charge_card", queue="machinery").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "t38_external_callbacks",
    X.jobs_sql(
        """SELECT id, CASE id // 16 % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'available' END AS state, CASE WHEN id // 16 % 4 = 3 THEN 0 ELSE attempt END AS attempt,
        (CASE WHEN id // 16 % 4 = 3 THEN :now ELSE run_at END)::VARCHAR AS run_at, CASE WHEN id // 16 % 4 IN (0, 2) THEN :now::VARCHAR END AS finalized_at FROM jobs WHERE state = 'waiting_external' AND id % 5 <> 0"""
    ),
)
def _(spark, sf):
    j = X.jobs(spark, sf)
    do = F.element_at(F.array(*map(F.lit, ["complete", "resume", "fail", "retry"])), (F.floor(F.col("id") / 16) % 4 + 1).cast("int"))
    lease = F.when(F.col("id") % 5 == 0, F.col("run_lease") + 1).when(F.col("id") % 2 == 0, F.col("run_lease"))
    calls = j.filter("callback_id IS NOT NULL").select("callback_id", lease.alias("run_lease"), do.alias("action"))
    return _changed(T.callback_external(j, calls, X.as_of()), *SHOW)


@query("t44_set_priority", X.jobs_sql("SELECT id, 2 AS priority, coalesce(first_priority, priority) AS first_priority FROM jobs WHERE state = 'available' AND priority <> 2"))
def _(spark, sf):
    a = T.set_priority(X.jobs(spark, sf), F.col("state") == "available", 2)
    return a.filter("changed").select("id", "priority", F.get_json_object("metadata", "$.original_priority").cast("int").alias("first_priority"))


@query("t45_move_queue", X.jobs_sql("SELECT id, 'archive' AS queue, queue AS first_queue, coalesce(first_priority, priority) AS first_priority FROM jobs WHERE state = 'scheduled' AND queue <> 'archive'"))
def _(spark, sf):
    a = T.move_queue(X.jobs(spark, sf), F.col("state") == "scheduled", "archive")
    note = lambda k: F.get_json_object("metadata", f"$.{k}")
    return a.filter("changed").select("id", "queue", note("original_queue").alias("first_queue"), note("original_priority").cast("int").alias("first_priority"))


@query("t56_heartbeats", X.jobs_sql("SELECT id, :now::VARCHAR AS heartbeat_at FROM jobs WHERE state = 'running' AND id % 4 = 0"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    return _changed(T.heartbeat(j, j.filter("id % 4 = 0").select("id", "run_lease"), X.as_of()), "id", "heartbeat_at")
