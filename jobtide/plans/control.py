"""Registered queries of scalars, batch operations, caches, control and schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import blake, cron, rules
from ..functions import scalars as S
from ..operators import batch as O
from ..operators import cache as K
from ..operators import control as C
from ..operators import reads as R
from ..registry import query
from ..sources import fixtures as X
from ..sources import inserts as I
from ..streaming import lifecycle as L
from .common import plain

BITS = "['scheduled', 'available', 'running', 'completed', 'retryable', 'failed', 'cancelled', 'waiting_external']"


@query("d01_state_mask", X.jobs_sql(f"SELECT id, coalesce(substr(unique_states, list_position({BITS}, state)::INTEGER, 1) = '1', false) AS claimed FROM jobs"))
def _(spark, sf):
    return X.jobs(spark, sf).select("id", S.state_in_mask(F.col("unique_states"), F.col("state")).alias("claimed"))


@query("d02_backoff", "SELECT a, u, least(pow(2, a) * (1 + 0.25 * (u / 4)), 86400) AS seconds FROM generate_series(1, 25) t(a), generate_series(0, 3) v(u)")
def _(spark, sf):
    grid = spark.range(1, 26).select(F.col("id").alias("a")).crossJoin(spark.range(4).select(F.col("id").alias("u")))
    return grid.select("a", "u", S.backoff_seconds(F.col("a"), F.col("u") / 4).alias("seconds"))


@query("d03_effective_priority", X.jobs_sql("SELECT id, greatest(1, priority - greatest(date_diff('second', run_at, :now), 0) // 43200)::INTEGER AS effective, priority AS off FROM jobs WHERE state = 'available'"))
def _(spark, sf):
    waited = F.timestamp_diff("SECOND", F.col("run_at"), X.as_of())
    eff = lambda a: S.effective_priority(F.col("priority"), waited, F.lit(a)).cast("int")
    return X.jobs(spark, sf).filter("state = 'available'").select("id", eff(43_200).alias("effective"), eff(0).alias("off"))


HASH = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i::INTEGER, 1))::HUGEINT)), lambda h, b: (h * 1099511628211 + b) % 18446744073709551616)"


def _hashes(customers):
    c = customers.select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("k"))
    return c.select("id", S.ordering_hash(F.col("k")).cast("string").alias("hash"), S.shard_of(F.col("k"), 8).alias("shard"))


@query("d07_ordering_hash", f"SELECT c_custkey::BIGINT AS id, h::VARCHAR AS hash, (h % 8)::INTEGER AS shard FROM (SELECT c_custkey, {HASH} AS h FROM (SELECT c_custkey, 'customer-' || c_custkey AS k FROM customer))")
def _(spark, sf):
    return _hashes(X.table(spark, sf, "customer"))


@query("d10_lane_names", X.jobs_sql("SELECT DISTINCT queue, priority, 'lane_' || substr(md5(queue || ':' || priority || ':' || (id % 3)), 1, 16) AS name FROM jobs"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    return j.select("queue", "priority", S.lane_sequence_name(F.col("queue"), F.col("priority"), F.col("id") % 3).alias("name")).distinct()


@query("d12_reserved_ranges", X.jobs_sql("SELECT id, 100 + row_number() OVER (PARTITION BY queue, priority, id % 3 ORDER BY id) - 1 AS lane_seq FROM jobs WHERE state = 'available'"))
def _(spark, sf):
    j = X.jobs(spark, sf).withColumn("enqueue_shard", F.col("id") % 3)
    heads = j.select("queue", "priority", "enqueue_shard").distinct().withColumn("next_seq", F.lit(100).cast("long"))
    return I.reserve_lanes(j.filter("state = 'available'"), heads, "id").select("id", "lane_seq")


@query("d13_ring_slots", "SELECT g - 20 AS g, (((g - 20) % 6) + 6) % 6 AS slot FROM generate_series(0, 60) t(g)")
def _(spark, sf):
    return spark.range(61).select((F.col("id") - 20).alias("g"), S.ring_slot(F.col("id") - 20, 6).alias("slot"))


@query("d14_staleness", "SELECT ms * 377 AS ms, greatest(greatest(ms * 377, 1000) * 3, 30000) AS by_ms, greatest((greatest(ms * 377, 1000) // 1000) * 3, 30)::INTEGER AS by_s FROM generate_series(0, 120) t(ms)")
def _(spark, sf):
    ms = F.col("id") * 377
    return spark.range(121).select(ms.alias("ms"), S.stale_ms(ms).alias("by_ms"), S.stale_whole_seconds(ms).alias("by_s"))


@query("d29_mask_text", "SELECT m, reverse(lpad(bin(m), 8, '0')) AS bits FROM generate_series(0, 255) t(m)")
def _(spark, sf):
    return spark.range(256).select(F.col("id").alias("m"), S.mask_text(F.col("id")).alias("bits"))


@query("d34_original_priority", X.jobs_sql("SELECT id, coalesce(first_priority, priority) AS p FROM jobs"))
def _(spark, sf):
    return X.jobs(spark, sf).select("id", S.original_priority(F.col("metadata"), F.col("priority")).alias("p"))


@query("d38_wait_seconds", X.jobs_sql("SELECT id, CASE WHEN date_diff('second', created_at, attempted_at) >= 0 THEN date_diff('second', created_at, attempted_at)::DOUBLE END AS wait_s FROM jobs"))
def _(spark, sf):
    return X.jobs(spark, sf).select("id", S.wait_seconds(F.col("created_at"), F.col("attempted_at")).alias("wait_s"))


@query("d40_http_outcome", "SELECT s, CASE WHEN s BETWEEN 200 AND 299 THEN 'completed' WHEN s >= 500 THEN 'retryable' ELSE 'terminal' END AS outcome FROM generate_series(100, 599) t(s)")
def _(spark, sf):
    return spark.range(100, 600).select(F.col("id").alias("s"), S.http_outcome(F.col("id")).alias("outcome"))


@query("d04_unique_keys")
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "kind", "queue")
    key = blake.hashes(lambda kind, queue, n: blake.key_parts(kind, queue, f'{{"n": {n}}}', n // 1000), 16)
    return j.select("id", key("kind", "queue", "id").alias("unique_key"))


@query("t41_batch_cancel", X.jobs_sql("SELECT (SELECT count(*) FROM m) AS total, 0::BIGINT AS pending, (SELECT count(*) FROM m WHERE state NOT IN ('completed', 'failed', 'cancelled')) AS succeeded, (SELECT count(*) FROM m WHERE state IN ('completed', 'failed', 'cancelled')) AS skipped, 0::BIGINT AS missing, 7::BIGINT AS operation_id", "m AS (SELECT * FROM jobs WHERE kind = 'send_email' AND queue = 'building')"))
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "kind", "queue", "state", "attempt", "finalized_at", "heartbeat_at", "deadline_at", "callback_id", "callback_timeout_at", "priority", "metadata", "run_at")
    items = O.run(j, 7, "cancel", X.as_of(), kind="send_email", queue="building")[1]
    return O.counters(items)


@query("t42_batch_items", X.jobs_sql("SELECT 1::BIGINT AS operation_id, id AS job_id, 'pending' AS status FROM jobs WHERE state = 'failed' AND queue = 'machinery'"))
def _(spark, sf):
    empty = spark.createDataFrame([], "operation_id long, job_id long, status string")
    j = X.jobs(spark, sf)
    once = O.materialise(j, empty, 1, states="failed", queue="machinery")
    return O.materialise(j, once, 1, states="failed", queue="machinery")


@query("t46_batch_cancelled", X.jobs_sql("SELECT CASE WHEN id % 2 = 0 THEN 'succeeded' ELSE 'skipped' END AS status, count(*) AS n FROM jobs WHERE state = 'failed' GROUP BY ALL"))
def _(spark, sf):
    items = X.jobs(spark, sf).filter("state = 'failed'").select(F.lit(1).cast("long").alias("operation_id"), F.col("id").alias("job_id"), F.when(F.col("id") % 2 == 0, "succeeded").otherwise("pending").alias("status"))
    return O.cancel_operation(items, 1).groupBy("status").agg(F.count("*").alias("n"))


@query("t47_batch_retention", X.jobs_sql("SELECT id FROM jobs WHERE state = 'completed' AND NOT finalized_at < :now - INTERVAL 2 DAY"))
def _(spark, sf):
    ops = X.jobs(spark, sf).filter("state = 'completed'").select("id", F.col("finalized_at").alias("finished_at"))
    return O.retain_operations(ops, X.as_of(), 2 * 86_400).select("id")


@query("t50_count_cache", X.jobs_sql("SELECT queue, state, count(*) AS n FROM (SELECT queue, CASE WHEN id % 6 = 0 THEN 'cancelled' ELSE state END AS state FROM jobs) GROUP BY ALL"))
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "queue", "state")
    touched = j.filter("id % 6 = 0")
    delta = K.deltas(touched, touched.withColumn("state", F.lit("cancelled")), ["queue", "state"])
    return K.apply(K.recount(j, ["queue", "state"]), delta, ["queue", "state"])


@query("t52_dirty_keys", X.jobs_sql("SELECT queue, state, count(*) AS n FROM jobs GROUP BY ALL"))
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "queue", "state")
    old = K.recount(j.filter("NOT (queue IN ('building', 'machinery') AND id % 4 = 0)"), ["queue", "state"])
    dirty = j.filter("queue IN ('building', 'machinery') AND id % 4 = 0").select("queue")
    return K.refresh_dirty(old, j, dirty, "queue", ["queue", "state"])


@query("t60_follow_ups", X.jobs_sql("SELECT id AS parent_id, 'audit' AS kind, 'low' AS queue FROM jobs WHERE state = 'failed' AND kind = 'charge_card' UNION ALL SELECT id, 'receipt', 'mail' FROM jobs WHERE state = 'completed' AND kind = 'charge_card'"))
def _(spark, sf):
    done = X.jobs(spark, sf).select("id", "kind", F.col("state").alias("outcome"))
    return L.follow_ups(done, {("failed", "charge_card"): ("audit", "low"), ("completed", "charge_card"): ("receipt", "mail")})


TOKENS = """WITH RECURSIVE a AS (SELECT (user_id % 5)::VARCHAR AS queue, ts, 3::BIGINT AS wanted, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts) AS n, epoch_us(ts) AS us FROM events),
f AS (SELECT queue, ts, wanted, n, us, least(wanted, 5)::BIGINT AS granted, (5.0 - least(wanted, 5))::DOUBLE AS rest FROM a WHERE n = 1
  UNION ALL SELECT queue, ts, wanted, n, us, least(wanted, floor(have + 1e-9))::BIGINT, have - least(wanted, floor(have + 1e-9))
  FROM (SELECT a.*, least(5.0, f.rest + ((a.us - f.us) / 1000000.0) * 0.001)::DOUBLE AS have FROM f JOIN a ON a.queue = f.queue AND a.n = f.n + 1))
SELECT queue, ts::VARCHAR AS ts, wanted, granted FROM f"""


@query("r02_token_bucket", TOKENS)
def _(spark, sf):
    e = X.events(spark, sf).select((F.col("job_id") % 5).cast("string").alias("queue"), "ts", F.lit(3).cast("long").alias("wanted"))
    return plain(C.token_bucket(e, rate=0.001, burst=5))


@query(
    "r04_weighted_shares",
    """WITH d(queue, weight, wanted, held) AS (VALUES ('a', 1, 50, 2), ('b', 2, 10, 0), ('c', 1, 0, 0), ('d', 4, 100, 5)), s AS (SELECT *, ceil(40 * weight / (sum(weight) OVER ()))::BIGINT AS share FROM d WHERE wanted > 0 OR held > 0),
    c AS (SELECT *, greatest(0, least(wanted, share - held)) AS could, 40 - sum(held) OVER () AS free FROM s)
    SELECT queue, weight, wanted, held, share, greatest(0, least(could, free - coalesce(sum(could) OVER (ORDER BY queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS granted FROM c""",
)
def _(spark, sf):
    d = spark.createDataFrame([("a", 1, 50, 2), ("b", 2, 10, 0), ("c", 1, 0, 0), ("d", 4, 100, 5)], "queue string, weight int, wanted int, held int")
    return C.weighted_grants(d, 40)


@query("r05_reserved_permits", "SELECT queue, reserved, 7::BIGINT AS overflow_pool FROM (VALUES ('a', 10), ('b', 3), ('c', 0)) t(queue, reserved)")
def _(spark, sf):
    return C.reserved_permits(spark.createDataFrame([("a", 10), ("b", 3), ("c", 0)], "queue string, reserved int"), 20)


@query("r06_effective_settings", "SELECT * FROM (VALUES ('a', 200, NULL), ('b', 50, 300000)) t(queue, poll_ms, deadline_ms)")
def _(spark, sf):
    base = spark.createDataFrame([("a", 200, 300_000), ("b", 200, 300_000)], "queue string, poll_ms int, deadline_ms int")
    over = spark.createDataFrame([("a", None, 0), ("b", 50, None)], "queue string, poll_ms int, deadline_ms int")
    return C.effective_settings(base, over)


@query("r07_completion_flushes", X.jobs_sql("SELECT id, (id % 4)::INTEGER AS shard, ((row_number() OVER (PARTITION BY id % 4 ORDER BY finalized_at, id) - 1) // 512)::BIGINT AS flush FROM jobs WHERE state = 'completed'"))
def _(spark, sf):
    return C.completion_shards(X.jobs(spark, sf).filter("state = 'completed'"), 4).select("id", "shard", "flush")


@query("r09_progress", "SELECT user_id::BIGINT AS job_id, max(event_id)::BIGINT AS generation, greatest(0, least(100, arg_max(event_id % 130 - 10, event_id)))::BIGINT AS percent FROM events GROUP BY user_id")
def _(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("generation"), (F.col("event_id").cast("long") % 130 - 10).alias("percent"))
    return C.progress_state(e)


@query("r15_lifecycle_fold", f"WITH {X.EVENTS} SELECT job_id, run_lease, CASE event_type WHEN 'started' THEN 'running' WHEN 'waiting' THEN 'waiting_external' WHEN 'retried' THEN 'retryable' ELSE event_type END AS state, n AS events FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, row_number() OVER (PARTITION BY job_id ORDER BY run_lease DESC) AS r FROM ev) WHERE r = 1")
def _(spark, sf):
    return L.fold(X.events(spark, sf))


@query("r16_event_metrics", f"WITH {X.EVENTS} SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS events FROM ev GROUP BY ALL")
def _(spark, sf):
    return plain(L.counts(X.events(spark, sf)))


@query("r20_unique_by_period", X.jobs_sql("SELECT min(id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY unique_key, epoch_us(created_at) // 3600000000 ORDER BY created_at, id) AS n, epoch_us(created_at) // 3600000000 AS b FROM jobs WHERE unique_key IS NOT NULL) WHERE n = 1 GROUP BY unique_key, b"))
def _(spark, sf):
    return C.dedupe_with_horizon(X.jobs(spark, sf), 3600).select("id")


@query("r21_ring_rotation", "SELECT ring, (max(generation) + 1) % 4 AS slot, max(generation) + 1 AS generation FROM (SELECT g % 3 AS ring, g AS generation FROM generate_series(0, 50) t(g)) GROUP BY ring")
def _(spark, sf):
    ledger = spark.range(51).select((F.col("id") % 3).alias("ring"), (F.col("id") % 4).alias("slot"), F.col("id").alias("generation"))
    return C.rotate(ledger, 4).withColumn("slot", F.col("slot").cast("long"))


def _schedules(spark):
    day = lambda d, h, m=0: datetime(2024, 4, d, h, m)
    rows = [
        ("hourly", "0 * * * *", "UTC", "coalesce", day(6, 9), day(1, 0), False), ("auckland", "0 9 * * *", "Pacific/Auckland", "catch_up", day(4, 0), day(1, 0), False),
        ("quick", "*/15 * * * * *", "UTC", "catch_up", datetime(2024, 4, 7, 11, 58, 50), day(1, 0), False), ("paused", "* * * * *", "UTC", "catch_up", day(6, 0), day(1, 0), True), ("first", "30 8 * * MON-FRI", "UTC", "catch_up", None, day(1, 8, 30), False),
    ]
    return spark.createDataFrame(rows, "name string, cron_expr string, timezone string, missed_fire_policy string, last_enqueued_at timestamp_ntz, created_at timestamp_ntz, paused boolean")


@query(
    "d37_zoned_fires",
    """SELECT * FROM (VALUES ('hourly', '2024-04-07 12:00:00'), ('auckland', '2024-04-04 20:00:00'), ('auckland', '2024-04-05 20:00:00'), ('auckland', '2024-04-06 21:00:00'),
    ('quick', '2024-04-07 11:59:00'), ('quick', '2024-04-07 11:59:15'), ('quick', '2024-04-07 11:59:30'), ('quick', '2024-04-07 11:59:45'), ('quick', '2024-04-07 12:00:00'), ('first', '2024-04-05 08:30:00')) t(name, fire_at)""",
)
def _(spark, sf):
    return plain(cron.owed_table(_schedules(spark), datetime(2024, 4, 7, 12, 0)))


@query(
    "t40_rule_cases",
    """SELECT * FROM (VALUES (1, 'completed'), (2, 'failed'), (3, 'ignored'), (4, 'completed'), (5, 'ignored'), (6, 'completed')) t(id, outcome)""",
)
def _(spark, sf):
    rows = [
        (1, '{"status": "ok", "n": 3}', 'has(payload.status)', 'payload.status == "bad"', 'payload.n > 2', '{"n": payload.n + 1}', "fail"),
        (2, '{"status": "bad"}', None, 'payload.status == "bad"', None, None, "complete"),
        (3, '{"status": "noise"}', 'payload.status != "noise"', None, None, None, "complete"),
        (4, '{"n": "text"}', 'payload.n > 2', 'payload.missing == 1', None, None, "complete"),
        (5, '{"n": 1}', None, None, 'payload.n > 2', None, "ignore"),
        (6, None, None, None, None, None, "complete"),
    ]
    calls = spark.createDataFrame(rows, "id int, payload string, callback_filter string, on_fail string, on_complete string, transform string, default_action string")
    return rules.resolve_table(calls).select("id", "outcome")


@query("a04_prepared_inserts", X.jobs_sql("SELECT id, kind, CASE WHEN id % 2 = 0 THEN 'scheduled' ELSE 'available' END AS state, 2 AS priority, 25 AS max_attempts, 'default' AS queue, (CASE WHEN id % 2 = 0 THEN created_at ELSE :now END)::VARCHAR AS run_at FROM jobs WHERE state = 'running'"))
def _(spark, sf):
    rows = X.jobs(spark, sf).filter("state = 'running'").select("id", "kind", F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("run_at"))
    return plain(I.prepare(rows, X.as_of()).select("id", "kind", "state", "priority", "max_attempts", "queue", "run_at"))


@query("a05_ids_in_order", X.jobs_sql("SELECT id AS ord, 1000 + row_number() OVER (ORDER BY id) AS id FROM jobs WHERE state = 'cancelled'"))
def _(spark, sf):
    rows = X.jobs(spark, sf).filter("state = 'cancelled'").select(F.col("id").alias("ord"))
    return I.with_ids(rows, 1000).withColumn("id", F.col("id").cast("long"))


@query("x01_counts_rollup", X.jobs_sql("SELECT queue, kind, state, count(*) AS n FROM jobs GROUP BY ROLLUP (queue, kind, state)"))
def _(spark, sf):
    return X.jobs(spark, sf).rollup("queue", "kind", "state").agg(F.count("*").alias("n"))


@query("b37_canonical_gauges", X.jobs_sql(" UNION ALL ".join(f"SELECT queue, '{g}' AS gauge, CAST(count(*) FILTER (WHERE state = '{g}') AS DOUBLE) AS value FROM jobs GROUP BY queue" for g in ["available", "running", "failed"])))
def _(spark, sf):
    return R.queue_health(X.jobs(spark, sf), X.as_of()).filter("gauge IN ('available', 'running', 'failed')")
