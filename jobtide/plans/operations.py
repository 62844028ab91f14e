"""Registered queries of batch operations, schedules, claims from ledgers, the compatible view, runtime steps, sinks and JSON, over whole tables."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import blake, cron, rules
from ..functions import scalars as S
from ..model import plus
from ..operators import batch as O
from ..operators import control as C
from ..operators import emission as E
from ..operators import reads as R
from ..operators import rebuild as B
from ..operators import runtime as U
from ..operators import schedules as H
from ..operators import transitions as T
from ..registry import query
from ..sources import fixtures as X
from ..sources import inserts as I
from ..sources.storage import cut, shared_dir
from ..streaming import workers as W
from .common import plain
from .rebuild import ledgers

NOW = X.AS_OF


# Batch operations: one for each supplier.
OPERATIONS = f"""ops AS (SELECT s_suppkey::BIGINT AS id, ['retry', 'cancel', 'set_priority', 'move_queue'][s_suppkey % 4 + 1] AS action,
  ['pending', 'scanning', 'running', 'cancelling', 'completed', 'cancelled', 'failed'][s_suppkey % 7 + 1] AS state,
  TIMESTAMP '{X.BASE}' + to_seconds((s_suppkey * 7919) % 500000) AS submitted_at,
  CASE WHEN s_suppkey % 7 > 0 THEN TIMESTAMP '{X.BASE}' + to_seconds((s_suppkey * 7919) % 500000 + 5) END AS started_at FROM supplier)"""


def operations(spark, sf):
    k = F.col("s_suppkey").cast("long")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    at = plus(F.lit(X.BASE).cast("timestamp_ntz"), (k * 7919) % 500_000)
    none = F.lit(None)
    return X.table(spark, sf, "supplier").select(
        k.alias("id"), pick(4, "retry", "cancel", "set_priority", "move_queue").alias("action"), F.lit("{}").alias("filter"), F.lit("{}").alias("spec"),
        pick(7, "pending", "scanning", "running", "cancelling", "completed", "cancelled", "failed").alias("state"), at.alias("submitted_at"), F.when(k % 7 > 0, plus(at, 5)).alias("started_at"),
        none.cast("string").alias("runner"), none.cast("string").alias("submitted_by"), none.cast("timestamp_ntz").alias("updated_at"), none.cast("timestamp_ntz").alias("finished_at"), none.cast("timestamp_ntz").alias("retention_until"),
    )


@query("b34_list_operations", f"WITH {OPERATIONS} SELECT id, action, state, submitted_at::VARCHAR AS submitted_at FROM ops WHERE state = 'running' ORDER BY ops.submitted_at DESC, id DESC LIMIT 1000")
def _(spark, sf):
    return plain(O.listed(operations(spark, sf), "running", 1000).select("id", "action", "state", "submitted_at"))


@query("b34_get_operation", f"WITH {OPERATIONS} SELECT id, action, state FROM ops WHERE id = 3")
def _(spark, sf):
    return O.found(operations(spark, sf), 3).select("id", "action", "state")


@query("t41_submit", f"WITH {OPERATIONS} SELECT id, action, state FROM ops UNION ALL SELECT 1000000, 'retry', 'pending'")
def _(spark, sf):
    return O.submit(operations(spark, sf), 1_000_000, "retry", {"states": "failed", "kind": "send_email"}, X.as_of()).select("id", "action", "state")


@query("t41_request_cancel", f"WITH {OPERATIONS} SELECT id, CASE WHEN id % 3 = 0 AND state IN ('pending', 'scanning', 'running') THEN 'cancelling' ELSE state END AS state FROM ops")
def _(spark, sf):
    o = operations(spark, sf)
    return O.request_cancel(o, o.filter("id % 3 = 0"), X.as_of()).select("id", "state")


@query("t41_claim_next", f"WITH {OPERATIONS}, one AS (SELECT id FROM ops WHERE state IN ('pending', 'scanning', 'running', 'cancelling') ORDER BY submitted_at, id LIMIT 1) SELECT id, CASE WHEN id IN (FROM one) AND state = 'pending' THEN 'scanning' ELSE state END AS state, CASE WHEN id IN (FROM one) THEN 'r1' END AS runner, (CASE WHEN id IN (FROM one) THEN coalesce(started_at, TIMESTAMP '{NOW}') ELSE started_at END)::VARCHAR AS started_at FROM ops")
def _(spark, sf):
    return plain(O.claim_next(operations(spark, sf), "r1", X.as_of()).select("id", "state", "runner", "started_at"))


@query("t41_scan", X.jobs_sql("SELECT count(*) AS total_matched, coalesce(max(id), 0) AS max_job_id FROM jobs WHERE state = 'failed' AND queue = 'machinery'"))
def _(spark, sf):
    return O.scan(X.jobs(spark, sf), 1, states="failed", queue="machinery")[1]


# Items: the jobs by the operation that their id falls to; every fifth operation has none that wait.
ITEMS = "items AS (SELECT 1 + id % (SELECT count(*) FROM supplier) AS operation_id, id AS job_id, CASE WHEN id % 3 = 0 AND (1 + id % (SELECT count(*) FROM supplier)) % 5 > 0 THEN 'pending' WHEN id % 3 = 1 THEN 'skipped' ELSE 'succeeded' END AS status FROM jobs)"


@query(
    "t41_finalize",
    X.jobs_sql(
        """SELECT o.id, CASE WHEN o.state = 'cancelling' THEN 'cancelled' WHEN o.state = 'running' AND coalesce(pending, 0) = 0 THEN 'completed' ELSE o.state END AS state,
        CASE WHEN o.state IN ('cancelling', 'completed', 'cancelled') OR (o.state = 'running' AND coalesce(pending, 0) = 0) THEN (:now + INTERVAL 90 DAY)::VARCHAR END AS retention_until
        FROM ops o LEFT JOIN (SELECT operation_id, count(*) FILTER (WHERE status = 'pending') AS pending FROM items GROUP BY 1) i ON i.operation_id = o.id""",
        OPERATIONS, ITEMS,
    ),
)
def _(spark, sf):
    n = F.lit(X.table(spark, sf, "supplier").count())
    op = F.col("id") % n + 1
    status = F.when((F.col("id") % 3 == 0) & (op % 5 > 0), "pending").when(F.col("id") % 3 == 1, "skipped").otherwise("succeeded")
    items = X.jobs(spark, sf).select(op.alias("operation_id"), F.col("id").alias("job_id"), status.alias("status"))
    return plain(O.finalize(operations(spark, sf), items, X.as_of()).select("id", "state", "retention_until"))


COLUMNS = ["id", "kind", "queue", "state", "attempt", "finalized_at", "heartbeat_at", "deadline_at", "callback_id", "callback_timeout_at", "priority", "metadata", "run_at"]


def _ran(spark, sf, action, **filters):
    return O.run(X.jobs(spark, sf).select(*COLUMNS), 9, action, X.as_of(), **filters)


@query("t43_batch_retry", X.jobs_sql("SELECT id, CASE WHEN m AND state IN ('failed', 'cancelled', 'waiting_external') THEN 'available' ELSE state END AS state, CASE WHEN m AND state IN ('failed', 'cancelled', 'waiting_external') THEN 0 ELSE attempt END AS attempt FROM (SELECT *, queue = 'household' AND kind = 'charge_card' AS m FROM jobs)"))
def _(spark, sf):
    return _ran(spark, sf, "retry", queue="household", kind="charge_card")[0].select("id", "state", "attempt")


@query("t43_batch_set_priority", X.jobs_sql("SELECT id, CASE WHEN m THEN 1 ELSE priority END AS priority, CASE WHEN m AND priority <> 1 THEN coalesce(first_priority, priority) ELSE first_priority END AS noted FROM (SELECT *, state = 'available' AND queue = 'building' AS m FROM jobs)"))
def _(spark, sf):
    return _ran(spark, sf, "set_priority", states="available", queue="building", priority_to=1)[0].select("id", "priority", F.get_json_object("metadata", "$.original_priority").cast("int").alias("noted"))


@query("t43_batch_move_queue", X.jobs_sql("SELECT id, CASE WHEN m THEN 'archive' ELSE queue END AS queue, CASE WHEN m THEN queue END AS noted FROM (SELECT *, kind = 'render_invoice' AND state NOT IN ('completed', 'failed', 'cancelled') AS m FROM jobs)"))
def _(spark, sf):
    return _ran(spark, sf, "move_queue", kind="render_invoice", queue_to="archive")[0].select("id", "queue", F.get_json_object("metadata", "$.original_queue").alias("noted"))


@query("t43_batch_outcomes", X.jobs_sql("SELECT id AS job_id, CASE WHEN state IN ('failed', 'cancelled', 'waiting_external') THEN 'succeeded' ELSE 'skipped' END AS status, ((row_number() OVER (ORDER BY id) - 1) // 100)::BIGINT AS chunk FROM jobs WHERE kind = 'sync_inventory'"))
def _(spark, sf):
    return _ran(spark, sf, "retry", kind="sync_inventory")[1].select("job_id", "status", "chunk")


# Schedules: one for each customer.
SCHEDULES = f"""sched AS (SELECT 's' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN '*/15 * * * *' WHEN c_custkey % 3 = 1 THEN '0 * * * *' ELSE '30 6 * * *' END AS cron_expr,
  CASE WHEN c_custkey % 2 = 0 THEN 'coalesce' ELSE 'catch_up' END AS missed_fire_policy, c_custkey % 4 + 1 AS priority, c_custkey % 11 = 0 AS paused, c_custkey AS k,
  CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '{NOW}' - to_seconds(c_custkey % 90000) END AS last_enqueued_at FROM customer)"""


def schedules(spark, sf):
    k = F.col("c_custkey").cast("long")
    none = F.lit(None)
    return X.table(spark, sf, "customer").select(
        F.concat(F.lit("s"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "*/15 * * * *").when(k % 3 == 1, "0 * * * *").otherwise("30 6 * * *").alias("cron_expr"), F.lit("UTC").alias("timezone"),
        F.lit("tick").alias("kind"), F.lower("c_mktsegment").alias("queue"), F.lit("{}").alias("args"), (k % 4 + 1).cast("int").alias("priority"), F.lit(25).alias("max_attempts"), F.array(F.lit("cron")).alias("tags"),
        F.lit('{"team":"a"}').alias("metadata"), F.when(k % 2 == 0, "coalesce").otherwise("catch_up").alias("missed_fire_policy"), F.when(k % 5 > 0, plus(X.as_of(), -(k % 90_000))).alias("last_enqueued_at"),
        F.lit(X.BASE).cast("timestamp_ntz").alias("created_at"), (k % 11 == 0).alias("paused"), none.cast("timestamp_ntz").alias("paused_at"), none.cast("string").alias("paused_by"), none.cast("timestamp_ntz").alias("updated_at"),
    )


@query("b35_cron_jobs", f"WITH {SCHEDULES} SELECT name, cron_expr, paused FROM sched ORDER BY name")
def _(spark, sf):
    return H.listed(schedules(spark, sf)).select("name", "cron_expr", "paused")


@query("t48_cron_put", f"WITH {SCHEDULES} SELECT name, CASE WHEN k % 6 = 0 THEN '5 4 * * *' ELSE cron_expr END AS cron_expr, paused, last_enqueued_at::VARCHAR AS last_enqueued_at, CASE WHEN k % 6 = 0 THEN '{NOW}' END AS updated_at FROM sched UNION ALL SELECT 'n' || k, '5 4 * * *', false, NULL, '{NOW}' FROM sched WHERE k % 6 = 0")
def _(spark, sf):
    s = schedules(spark, sf)
    old = s.filter(F.substring("name", 2, 20).cast("long") % 6 == 0).withColumn("cron_expr", F.lit("5 4 * * *"))
    new = old.withColumn("name", F.concat(F.lit("n"), F.substring("name", 2, 20)))
    return plain(H.put(s, old.unionByName(new), X.as_of()).select("name", "cron_expr", "paused", "last_enqueued_at", "updated_at"))


@query("t48_cron_delete", f"WITH {SCHEDULES} SELECT name FROM sched WHERE k % 4 > 0")
def _(spark, sf):
    s = schedules(spark, sf)
    return H.delete(s, s.filter(F.substring("name", 2, 20).cast("long") % 4 == 0)).select("name")


@query("t48_cron_pause", f"WITH {SCHEDULES} SELECT name, paused OR k % 2 = 0 AS paused, CASE WHEN k % 2 = 0 THEN 'ops' END AS paused_by, CASE WHEN k % 2 = 0 THEN '{NOW}' END AS paused_at, last_enqueued_at::VARCHAR AS last_enqueued_at FROM sched")
def _(spark, sf):
    s = schedules(spark, sf)
    return plain(H.set_paused(s, s.filter(F.substring("name", 2, 20).cast("long") % 2 == 0), True, X.as_of(), "ops").select("name", "paused", "paused_by", "paused_at", "last_enqueued_at"))


@query("t48_cron_resume", f"WITH {SCHEDULES} SELECT name, paused AND k % 2 > 0 AS paused FROM sched")
def _(spark, sf):
    s = schedules(spark, sf)
    return H.set_paused(s, s.filter(F.substring("name", 2, 20).cast("long") % 2 == 0), False, X.as_of()).select("name", "paused")


@query("t48_cron_trigger", f"WITH {SCHEDULES} SELECT name, 'available' AS state, '{NOW}' AS run_at, 'a' AS team, name AS cron_name, 'true' AS manually FROM sched WHERE k % 7 = 0")
def _(spark, sf):
    s = schedules(spark, sf)
    jobs = H.trigger(s, s.filter(F.substring("name", 2, 20).cast("long") % 7 == 0), X.as_of())
    part = lambda c: F.get_json_object("metadata", f"$.{c}")
    return plain(jobs.select("name", "state", "run_at", part("team").alias("team"), part("cron_name").alias("cron_name"), part("triggered_manually").alias("manually")))


#: The fires of a schedule's expression up to the moment: every quarter of an hour, every hour, or every day at half past six.
FIRES = f"""steps AS (SELECT *, CASE k % 3 WHEN 0 THEN 900 WHEN 1 THEN 3600 ELSE 86400 END AS step, CASE k % 3 WHEN 2 THEN 23400 ELSE 0 END AS off FROM sched WHERE NOT paused),
ends AS (SELECT *, epoch_us(coalesce(last_enqueued_at, TIMESTAMP '{X.BASE}' - INTERVAL 1 MINUTE)) // 1000000 AS a, epoch_us(TIMESTAMP '{NOW}') // 1000000 AS b FROM steps),
nth AS (SELECT *, (a - off) // step + 1 AS first, (b - off) // step AS last FROM ends),
fires AS (SELECT name, TIMESTAMP '1970-01-01' + to_seconds(off + step * n) AS fire_at FROM (SELECT *, unnest(CASE WHEN last_enqueued_at IS NULL OR missed_fire_policy = 'coalesce' THEN CASE WHEN last >= first THEN [last] ELSE [] END ELSE generate_series(first, least(last, first + 999)) END) AS n FROM nth))"""


@query("d37_owed_fires", f"WITH {SCHEDULES}, {FIRES} SELECT name, fire_at::VARCHAR AS fire_at FROM fires")
def _(spark, sf):
    return plain(cron.owed_table(schedules(spark, sf), datetime.fromisoformat(NOW)))


#: A schedule's step and offset in seconds, and the moments in seconds.
STEPS = f"st AS (SELECT *, CASE k % 3 WHEN 0 THEN 900 WHEN 1 THEN 3600 ELSE 86400 END AS step, CASE k % 3 WHEN 2 THEN 23400 ELSE 0 END AS off, epoch_us(coalesce(last_enqueued_at, TIMESTAMP '{NOW}' - INTERVAL 1 DAY)) // 1000000 AS a, epoch_us(TIMESTAMP '{NOW}') // 1000000 AS b FROM sched)"


@query("d35_next_fires", f"WITH {SCHEDULES}, {STEPS} SELECT name, (TIMESTAMP '1970-01-01' + to_seconds(off + step * ((b - off) // step + 1)))::VARCHAR AS next_fire FROM st")
def _(spark, sf):
    return plain(cron.fires_table(schedules(spark, sf), datetime.fromisoformat(NOW)).select("name", "next_fire"))


@query("d36_latest_fires", f"WITH {SCHEDULES}, {STEPS} SELECT name, CASE WHEN off + step * ((b - off) // step) > a THEN (TIMESTAMP '1970-01-01' + to_seconds(off + step * ((b - off) // step)))::VARCHAR END AS latest_fire FROM st")
def _(spark, sf):
    return plain(cron.fires_table(schedules(spark, sf), datetime.fromisoformat(NOW)).select("name", "latest_fire"))


@query("r14_evaluator", f"WITH {SCHEDULES}, {FIRES} SELECT s.name, coalesce(max(fire_at), any_value(last_enqueued_at))::VARCHAR AS last_enqueued_at, count(fire_at) AS jobs FROM sched s LEFT JOIN fires USING (name) GROUP BY s.name")
def _(spark, sf):
    moved, jobs = H.evaluate(schedules(spark, sf), datetime.fromisoformat(NOW))
    n = jobs.groupBy("name").agg(F.count("*").alias("jobs"))
    return plain(moved.select("name", "last_enqueued_at").join(n, "name", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0))))


@query("t49_cron_enqueue", f"WITH {SCHEDULES} SELECT name, '2024-01-07 12:00:00' AS fire_at FROM sched WHERE NOT paused AND k % 3 > 0")
def _(spark, sf):
    s = schedules(spark, sf)
    fires = s.select("name", F.lit("2024-01-07 12:00:00").cast("timestamp_ntz").alias("fire_at"))
    # what the evaluators saw: every third schedule has moved on since
    moved = F.substring("name", 2, 20).cast("long") % 3 == 0
    seen = s.select("name", F.when(moved, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("last_enqueued_at")).alias("seen"))
    return plain(cron.enqueue_fires(s, fires, seen)[1].select("name", "fire_at"))


# Claims from the ledgers: the lanes' entries, with evidence of earlier attempts by id.
def _entries(spark, sf):
    l = X.lanes(spark, sf).withColumnRenamed("id", "job_id")
    return cut(l.select("job_id", "queue", "priority", "enqueue_shard", "lane_seq", "attempt", "run_lease", "max_attempts", (F.col("lane_seq") % 4).cast("int").alias("ready_slot"), F.floor(F.col("lane_seq") / 64).cast("long").alias("ready_generation")))


def _evidence(e):
    run = lambda cond: e.filter(cond).select("job_id", (F.col("run_lease") + 1).alias("run_lease"))
    keys = [c for c in B.PLACE if c != "lane_seq"]
    packed = e.filter("job_id % 13 = 5").select("queue", F.array("job_id").alias("job_ids"), F.array(F.col("run_lease") + 1).alias("run_leases"))
    t = {"tombstones": e.filter("job_id % 17 = 0").select(*B.PLACE), "attempts": B.multiranges(e.filter("lane_seq % 10 < 3"), keys, "lane_seq", "lane_ranges"), "completions": packed}
    return t | {name: run(f"job_id % 31 = {i}") for i, name in enumerate(("claims", "closures", "leases", "done", "deferred", "dlq"))} | {"ready": e}


ENTRIES = "e AS (SELECT *, lane_seq % 4 AS ready_slot, (lane_seq // 64)::BIGINT AS ready_generation FROM lanes)"
SPENT = "(id % 17 = 0 OR lane_seq % 10 < 3)"


@query("t03_spent_receipts", X.jobs_sql(f"SELECT id AS job_id, {SPENT} AS spent FROM e", X.LANES, ENTRIES))
def _(spark, sf):
    e = _entries(spark, sf)
    return E.spent(e, _evidence(e), receipts=True).select("job_id", "spent")


@query("t03_spent_ledgers", X.jobs_sql(f"SELECT id AS job_id, {SPENT} OR id % 31 < 6 OR id % 13 = 5 AS spent FROM e", X.LANES, ENTRIES))
def _(spark, sf):
    e = _entries(spark, sf)
    return E.spent(e, _evidence(e), receipts=False).select("job_id", "spent")


@query("t03_skip_spent", X.jobs_sql("SELECT queue, priority, enqueue_shard, 1::BIGINT AS next_claim_seq, coalesce(min(lane_seq) FILTER (WHERE state <> 'completed'), max(lane_seq) + 1) AS next FROM lanes GROUP BY ALL", X.LANES))
def _(spark, sf):
    l = X.lanes(spark, sf)
    heads = l.select(*B.LANE).distinct().withColumn("next_claim_seq", F.lit(1).cast("long"))
    return E.skip_spent(l.withColumn("spent", F.col("state") == "completed"), heads)


def _selected(spark, sf):
    return _entries(spark, sf).withColumns({"spent": F.col("job_id") % 5 == 0, "effective": F.greatest(F.col("priority") - 1, F.lit(1))})


CHOSEN = "ch AS (SELECT *, greatest(priority - 1, 1) AS effective FROM e WHERE id % 5 > 0)"


@query("t04_attempt_batches", X.jobs_sql("SELECT ready_slot::INTEGER AS ready_slot, ready_generation, queue, priority, enqueue_shard, min(lane_seq) AS first_lane_seq, max(lane_seq) + 1 AS next_lane_seq, count(*) AS claimed_count, string_agg(lane_seq, ',' ORDER BY lane_seq) AS seqs FROM ch GROUP BY ALL", X.LANES, ENTRIES, CHOSEN))
def _(spark, sf):
    out = E.attempt_batches(_selected(spark, sf), 3, X.as_of())
    seqs = F.flatten(F.transform("lane_ranges", lambda r: F.sequence(r["lo"], r["hi"] - 1)))
    return out.select("ready_slot", "ready_generation", *B.LANE, "first_lane_seq", "next_lane_seq", F.col("claimed_count").cast("long").alias("claimed_count"), F.array_join(seqs.cast("array<string>"), ",").alias("seqs"))


@query("t04_claim_items", X.jobs_sql("SELECT id AS job_id, attempt + 1 AS attempt, run_lease + 1 AS run_lease, 500 + row_number() OVER (ORDER BY id) AS receipt_id, row_number() OVER (PARTITION BY ready_slot, ready_generation, queue, effective, enqueue_shard ORDER BY lane_seq, id)::INTEGER AS claim_batch_index FROM ch", X.LANES, ENTRIES, CHOSEN))
def _(spark, sf):
    return E.claim_items(_selected(spark, sf), 3, 500).select("job_id", "attempt", "run_lease", "receipt_id", "claim_batch_index")


@query("t04_compact_batches", X.jobs_sql("SELECT ready_slot::INTEGER AS ready_slot, ready_generation, queue, effective, enqueue_shard, count(*) AS claimed_count, string_agg(id, ',' ORDER BY lane_seq, id) AS job_ids, string_agg(run_lease + 1, ',' ORDER BY lane_seq, id) AS run_leases, (:now + INTERVAL 300 SECOND)::VARCHAR AS deadline_at FROM ch GROUP BY ALL", X.LANES, ENTRIES, CHOSEN))
def _(spark, sf):
    out = E.compact_batches(E.claim_items(_selected(spark, sf), 3, 500), X.as_of(), 300)
    return plain(out.select("ready_slot", "ready_generation", "queue", "effective", "enqueue_shard", F.col("claimed_count").cast("long").alias("claimed_count"), "job_ids", "run_leases", "deadline_at"))


@query("t05_lease_rows", X.jobs_sql("SELECT id AS job_id, 'running' AS state, effective AS priority, attempt + 1 AS attempt, run_lease + 1 AS run_lease, (:now + INTERVAL 60 SECOND)::VARCHAR AS deadline_at FROM ch", X.LANES, ENTRIES, CHOSEN))
def _(spark, sf):
    return plain(E.lease_rows(_selected(spark, sf), 1, 7, X.as_of(), 60).select("job_id", "state", "priority", "attempt", "run_lease", "deadline_at"))


# The view of all columns: what the fixture's ledgers keep, less the claims, which have no leg in it.
HOME = "CASE WHEN state IN ('scheduled', 'retryable') THEN 'deferred' WHEN state = 'available' THEN 'ready' WHEN state = 'waiting_external' THEN 'leases' WHEN state = 'running' THEN CASE id % 3 WHEN 0 THEN 'leases' ELSE 'claims' END ELSE 'ended' END"
COMPAT = f"""SELECT id, kind, queue, '{{"n":' || id || '}}' AS args, state, priority, attempt, max_attempts, run_at::VARCHAR AS run_at, CASE WHEN home = 'leases' THEN heartbeat_at::VARCHAR END AS heartbeat_at,
  CASE WHEN home = 'leases' THEN deadline_at::VARCHAR END AS deadline_at, attempted_at::VARCHAR AS attempted_at, finalized_at::VARCHAR AS finalized_at, created_at::VARCHAR AS created_at, nullif(n_errors, 0) AS errors,
  CASE WHEN first_priority IS NOT NULL THEN first_priority::VARCHAR END AS first_priority, CASE WHEN home = 'leases' AND id % 2 = 0 THEN 'yes' END AS callback_result, array_to_string(tags, ',') AS tags, unique_key, unique_states,
  CASE WHEN home = 'leases' THEN callback_id END AS callback_id, CASE WHEN home = 'leases' THEN callback_timeout_at::VARCHAR END AS callback_timeout_at, CASE WHEN home = 'leases' AND id % 2 = 0 THEN 'payload.ok' END AS callback_filter,
  run_lease, CASE WHEN home = 'leases' AND id % 2 = 0 THEN 7 WHEN id % 4 = 0 THEN id % 100 END AS percent
  FROM (SELECT *, {HOME} AS home FROM jobs) WHERE home <> 'claims'"""


def _compat_ledgers(spark, sf):
    t = ledgers(spark, sf, rich=True)
    on = t["leases"].filter("job_id % 2 = 0").select("job_id", "run_lease", F.lit('"yes"').alias("callback_result"), F.lit("payload.ok").alias("callback_filter"), F.lit('{"percent":7}').alias("progress"))
    return t | {"attempt_state": on.withColumns({c: F.lit(None).cast("string") for c in ("callback_on_complete", "callback_on_fail", "callback_transform")})}


@query("a02_compat_jobs", X.jobs_sql(COMPAT))
def _(spark, sf):
    v = B.compat_jobs(_compat_ledgers(spark, sf))
    part = lambda c, k: F.get_json_object(c, f"$.{k}")
    v = v.withColumns({"errors": F.size("errors"), "first_priority": part("metadata", "original_priority"), "callback_result": part("metadata", "_callback_result"), "percent": part("progress", "percent").cast("long")})
    v = v.withColumn("errors", F.when(F.col("errors") > 0, F.col("errors")))
    return plain(v.drop("metadata", "progress", "callback_on_complete", "callback_on_fail", "callback_transform"))


@query("t55_delete_jobs", X.jobs_sql("SELECT id AS job_id, kind, queue, state FROM jobs WHERE id % 6 > 0 OR (state = 'running' AND id % 3 > 0)"))
def _(spark, sf):
    t = ledgers(spark, sf)
    return B.current_jobs(B.delete_job(t, X.jobs(spark, sf).filter("id % 6 = 0").select("id"))).select("job_id", "kind", "queue", "state")


@query("t55_removed_counts", X.jobs_sql("SELECT queue, priority, enqueue_shard, -count(*) AS delta FROM lanes WHERE id % 6 = 0 AND (state IN ('completed', 'cancelled') OR (state = 'failed' AND id % 32 <> 11)) GROUP BY ALL", X.LANES))
def _(spark, sf):
    t = ledgers(spark, sf)
    return B.delete_job(t, X.jobs(spark, sf).filter("id % 6 = 0").select("id"))["removed"]


@query("t09_migrated", X.jobs_sql("""SELECT old_id, 900000 + row_number() OVER (ORDER BY old_id) AS id, CASE WHEN dup THEN 'cancelled' WHEN old_id % 2 = 0 THEN 'scheduled' ELSE 'retryable' END AS state, CASE WHEN old_id % 2 = 0 THEN greatest(attempt - 1, 0) ELSE attempt END AS attempt, (:now + to_seconds(old_id % 100))::VARCHAR AS run_at
    FROM (SELECT id AS old_id, attempt, unique_key IS NOT NULL AND (unique_key IN (SELECT unique_key FROM jobs WHERE state = 'available' AND unique_key IS NOT NULL) OR row_number() OVER (PARTITION BY unique_key ORDER BY id) > 1) AS dup FROM jobs WHERE state = 'running' AND id % 5 > 0)"""))
def _(spark, sf):
    j = X.jobs(spark, sf)
    asked = j.select("id", F.when(F.col("id") % 5 > 0, F.col("run_lease")).otherwise(-1).alias("run_lease"), (F.col("id") % 100).alias("delay_s"), (F.col("id") % 2 == 0).alias("snooze"))
    held = j.filter("state = 'available' AND unique_key IS NOT NULL").select("unique_key")
    return plain(U.migrate(j, asked, held, X.as_of(), 900_000)[1].select("old_id", "id", "state", "attempt", "run_at"))


@query("t54_write_routing", X.jobs_sql("SELECT id, CASE WHEN s IN ('scheduled', 'retryable') THEN 'deferred' ELSE 'hot' END AS tier, s AS state FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'available' WHEN id % 4 = 1 THEN 'retryable' ELSE state END AS s FROM jobs)"))
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "queue", "state")
    away = F.col("state").isin("scheduled", "retryable")
    rows = j.filter("id % 4 < 2").withColumn("state", F.when(F.col("id") % 4 == 0, "available").otherwise("retryable"))
    hot, deferred = U.route(j.filter(~away), j.filter(away), rows, away)
    return hot.select("id", F.lit("hot").alias("tier"), "state").unionByName(deferred.select("id", F.lit("deferred").alias("tier"), "state"))


@query("t23_aged_out_instances", f"WITH {X.INST} SELECT instance_id FROM instances WHERE last_seen_at >= TIMESTAMP '{NOW}' - INTERVAL 600 SECOND")
def _(spark, sf):
    return U.age_out(X.instances(spark), X.as_of(), 600).select("instance_id")


@query("t23_aged_out_jobs", X.jobs_sql("SELECT id FROM jobs WHERE heartbeat_at >= :now - INTERVAL 1 SECOND"))
def _(spark, sf):
    return U.age_out(X.jobs(spark, sf), X.as_of(), 0, "heartbeat_at").select("id")  # a second at least


REPORTS = "rep AS (SELECT 'q' || (c_custkey % 500) AS queue, c_custkey AS inst, CASE WHEN c_custkey % 500 < 30 THEN c_custkey // 1000 ELSE 8 END AS max_workers, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 500) % 2 = 0 OR c_custkey % 97 = 0 END AS dlq FROM customer)"


@query(
    "b18_config_agreement",
    f"""WITH {REPORTS}, f AS (SELECT queue, arg_min(max_workers, inst) AS w, min_by(dlq, inst) FILTER (WHERE true) AS d0, list(dlq ORDER BY inst)[1] AS d FROM rep GROUP BY queue),
    m AS (SELECT rep.*, w, d, rep.max_workers = w AND (dlq IS NULL OR d IS NULL OR dlq = d) AS ok FROM rep JOIN f USING (queue))
    SELECT queue, bool_and(ok) AS agrees, coalesce(any_value(d), list(dlq ORDER BY inst) FILTER (WHERE ok AND dlq IS NOT NULL)[1]) AS dlq, any_value(w) AS max_workers FROM m GROUP BY queue""",
)
def _(spark, sf):
    k = F.col("c_custkey").cast("long")
    rep = X.table(spark, sf, "customer").select(F.concat(F.lit("q"), (k % 500).cast("string")).alias("queue"), k.alias("inst"), F.when(k % 500 < 30, F.floor(k / 1000)).otherwise(8).alias("max_workers"), F.when(k % 3 > 0, ((k % 500) % 2 == 0) | (k % 97 == 0)).alias("dlq"))
    return U.configs(rep, ["max_workers"], "inst")


# Runtime steps.
@query("r01_dispatch", X.jobs_sql(f"""SELECT q.queue, least(permits, tokens)::BIGINT AS asked, least(least(permits, tokens), coalesce(n, 0))::BIGINT AS claimed, (least(permits, tokens) - least(least(permits, tokens), coalesce(n, 0)))::BIGINT AS refunded
    FROM (VALUES ('automobile', 40, 25), ('building', 10, 100), ('furniture', 100000, 100000), ('machinery', 5, 5), ('household', 0, 9)) q(queue, permits, tokens)
    LEFT JOIN (SELECT queue, count(*) AS n FROM jobs WHERE state = 'available' AND run_at <= :now AND queue NOT IN (SELECT queue FROM queue_meta WHERE paused) GROUP BY queue) d USING (queue)""", X.META))
def _(spark, sf):
    rows = [("automobile", 40, 25.7), ("building", 10, 100.0), ("furniture", 100_000, 100_000.0), ("machinery", 5, 5.0), ("household", 0, 9.0)]
    return U.dispatch(X.jobs(spark, sf), X.queue_meta(spark), spark.createDataFrame(rows, "queue string, permits long, tokens double"), X.as_of())[1]


@query("r01_dispatched_jobs", X.jobs_sql(f"SELECT id, attempt + 1 AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority, run_at, id) AS n FROM jobs WHERE state = 'available' AND run_at <= :now) WHERE (queue = 'automobile' AND n <= 25) OR (queue = 'building' AND n <= 10)"))
def _(spark, sf):
    rows = [("automobile", 40, 25.7), ("building", 10, 100.0)]
    return U.dispatch(X.jobs(spark, sf), X.queue_meta(spark), spark.createDataFrame(rows, "queue string, permits long, tokens double"), X.as_of())[0].filter("changed").select("id", "attempt")


@query("r03_default_bursts", "SELECT r * 0.25 AS rate, b::DOUBLE AS burst, CASE WHEN b > 0 THEN b ELSE greatest(1, ceil(r * 0.25)) END::DOUBLE AS used FROM generate_series(0, 40) t(r), generate_series(0, 2) v(b)")
def _(spark, sf):
    grid = spark.range(41 * 3).select((F.floor(F.col("id") / 3) * 0.25).cast("double").alias("rate"), (F.col("id") % 3).cast("double").alias("burst"))
    return grid.withColumn("used", C.burst_of(F.col("rate"), F.col("burst")))


DEMAND = "d AS (SELECT 'q' || lpad(c_custkey::VARCHAR, 9, '0') AS queue, 1 + c_custkey % 4 AS weight, c_custkey % 30 AS wanted, c_custkey % 3 AS held FROM customer)"


def demand(spark, sf):
    k = F.col("c_custkey").cast("long")
    return X.table(spark, sf, "customer").select(F.concat(F.lit("q"), F.lpad(k.cast("string"), 9, "0")).alias("queue"), (1 + k % 4).alias("weight"), (k % 30).alias("wanted"), (k % 3).alias("held"))


@query(
    "r04_weighted_queues",
    f"""WITH {DEMAND}, s AS (SELECT *, ceil(100000 * weight / (sum(weight) OVER ()))::BIGINT AS share FROM d WHERE wanted > 0 OR held > 0), c AS (SELECT *, greatest(0, least(wanted, share - held)) AS could, 100000 - sum(held) OVER () AS free FROM s)
    SELECT queue, share, greatest(0, least(could, free - coalesce(sum(could) OVER (ORDER BY queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS granted FROM c""",
)
def _(spark, sf):
    return C.weighted_grants(demand(spark, sf), 100_000).select("queue", "share", "granted")


@query("r05_reserved_queues", f"WITH {DEMAND} SELECT queue, held AS reserved, greatest(0, 100000 - (SELECT sum(held) FROM d))::BIGINT AS overflow_pool FROM d")
def _(spark, sf):
    return C.reserved_permits(demand(spark, sf).select("queue", F.col("held").alias("reserved")), 100_000)


@query("r06_effective_queues", f"WITH {DEMAND} SELECT queue, CASE WHEN held = 0 THEN weight * 10 ELSE 200 END AS poll_ms, CASE WHEN held = 1 AND wanted % 2 = 0 THEN NULL WHEN held = 1 THEN wanted * 1000 ELSE 300000 END AS deadline_ms FROM d")
def _(spark, sf):
    d = demand(spark, sf)
    over = d.filter("held < 2").select("queue", F.when(F.col("held") == 0, F.col("weight") * 10).alias("poll_ms"), F.when(F.col("held") == 1, F.when(F.col("wanted") % 2 == 0, 0).otherwise(F.col("wanted") * 1000)).alias("deadline_ms"))
    return C.effective_settings(d.select("queue", F.lit(200).cast("long").alias("poll_ms"), F.lit(300_000).cast("long").alias("deadline_ms")), over)


@query("r08_heartbeat_batches", X.jobs_sql("SELECT id, kind, ((row_number() OVER (PARTITION BY kind ORDER BY id) - 1) // 50)::BIGINT AS batch FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'progress' ELSE 'heartbeat' END AS kind FROM jobs WHERE state = 'running')"))
def _(spark, sf):
    j = X.jobs(spark, sf).filter("state = 'running'").select("id", "run_lease")
    pending = j.select("id", F.lit(5).alias("generation"), F.when(F.col("id") % 3 == 0, 4).otherwise(5).alias("acked"))
    return U.heartbeat_batches(j, pending, 50).select("id", "kind", "batch")


@query("r11_due_branches", X.jobs_sql("SELECT id, age IS NULL OR age * 1000 >= ms AS due, greatest(coalesce(age * 1000 // ms, 1) - 1, 0)::BIGINT AS missed FROM (SELECT id, 250 * (1 + id % 240) AS ms, CASE WHEN id % 9 > 0 THEN date_diff('second', created_at, :now) % 300 END AS age FROM jobs)"))
def _(spark, sf):
    age = F.when(F.col("id") % 9 > 0, F.timestamp_diff("SECOND", "created_at", X.as_of()) % 300)
    b = X.jobs(spark, sf).select("id", (250 * (1 + F.col("id") % 240)).alias("interval_ms"), plus(X.as_of(), -age).alias("last_run_at"))
    return U.due_branches(b, X.as_of()).select("id", "due", "missed")


@query("r12_branch_health")
def _(spark, sf):
    e = X.table(spark, sf, "events").select((F.col("user_id") % 13).cast("string").alias("branch"), F.col("event_id").cast("long").alias("tick"), F.lit(1000).cast("long").alias("interval_ms"), (F.col("event_id").cast("long") * 7919 % 2500).alias("took_ms"))
    return U.branch_health(e)


@query("r13_prune_backoff")
def _(spark, sf):
    k = F.col("event_id").cast("long")
    return U.prune_backoff(X.table(spark, sf, "events").select((F.col("user_id") % 7).cast("string").alias("ring"), k.alias("tick"), F.when(k % 11 == 0, "pruned").when(k % 5 == 0, "noop").when(k % 2 == 0, "active").otherwise("blocked").alias("outcome")))


CLAIMERS = f"le AS (SELECT 'q' || (c_custkey // 4) AS queue, c_custkey % 4 AS claimer_slot, 'o' || (c_custkey % 6) AS owner, c_custkey % 9 AS lease_epoch, TIMESTAMP '{NOW}' - to_milliseconds(c_custkey * 37 % 900) AS last_claimed_at, TIMESTAMP '{NOW}' + to_milliseconds(c_custkey * 53 % 3000 - 500) AS expires_at FROM customer WHERE c_custkey % 7 > 0)"


@query(
    "r17_claimer_leases",
    f"""WITH {CLAIMERS}, asks AS (SELECT DISTINCT 'q' || (c_custkey // 4) AS queue, 'o' || (c_custkey // 4 % 6) AS me FROM customer), slots AS (SELECT queue, me, unnest([0, 1, 2, 3]) AS claimer_slot FROM asks),
    r AS (SELECT s.queue, s.me, s.claimer_slot, CASE WHEN owner = me THEN 0 WHEN owner IS NULL THEN 1 WHEN expires_at <= TIMESTAMP '{NOW}' OR last_claimed_at <= TIMESTAMP '{NOW}' - INTERVAL 500 MILLISECOND THEN 2 END AS r FROM slots s LEFT JOIN le USING (queue, claimer_slot)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY r, claimer_slot) AS n FROM r WHERE r IS NOT NULL) WHERE n = 1)
    SELECT queue, claimer_slot, coalesce(me, owner) AS owner, (CASE WHEN r = 0 THEN lease_epoch WHEN r = 1 THEN 0 WHEN r = 2 THEN lease_epoch + 1 ELSE lease_epoch END)::BIGINT AS lease_epoch,
    (CASE WHEN me IS NOT NULL THEN TIMESTAMP '{NOW}' + INTERVAL 3 SECOND ELSE expires_at END)::VARCHAR AS expires_at FROM le FULL JOIN b USING (queue, claimer_slot)""",
)
def _(spark, sf):
    k = F.col("c_custkey").cast("long")
    ms = lambda n: F.timestamp_add("MICROSECOND", n * 1000, X.as_of())
    c = X.table(spark, sf, "customer").select(k.alias("k"), F.concat(F.lit("q"), F.floor(k / 4).cast("string")).alias("queue"))
    k = F.col("k")
    leases = c.filter("k % 7 > 0").select("queue", (k % 4).cast("int").alias("claimer_slot"), F.concat(F.lit("o"), (k % 6).cast("string")).alias("owner"), (k % 9).alias("lease_epoch"), ms(-(k * 37 % 900)).alias("last_claimed_at"), ms(k * 53 % 3000 - 500).alias("expires_at"))
    asks = c.select("queue", F.concat(F.lit("o"), (F.floor(k / 4) % 6).cast("string")).alias("owner")).distinct()
    return plain(U.claimer_leases(leases, asks, X.as_of(), 4).drop("last_claimed_at"))


@query("u10_work_one", X.jobs_sql("SELECT id, CASE WHEN id = (SELECT id FROM jobs WHERE state = 'available' AND run_at <= :now AND kind = 'charge_card' ORDER BY priority, run_at, id LIMIT 1) THEN 'completed' ELSE state END AS state FROM jobs"))
def _(spark, sf):
    return U.work_one(X.jobs(spark, sf), "charge_card", "completed", X.as_of()).select("id", "state")


REGISTRY = W.Registry()


@REGISTRY.task("send_email")
def _send(args, context):
    context.set_progress(args["n"] % 150)
    return None if args["n"] % 2 else W.snooze(60)


@REGISTRY.task("charge_card")
def _charge(args, context):
    if args["n"] % 3 == 0:
        raise W.Terminal("declined")
    if args["n"] % 3 == 1:
        raise RuntimeError("gateway")
    return W.cancel("void")


@query("u01_handlers", X.jobs_sql("""SELECT id, CASE kind WHEN 'send_email' THEN CASE WHEN id % 2 = 1 THEN 'completed' ELSE 'snooze' END WHEN 'charge_card' THEN ['terminal', 'retryable', 'cancel'][id % 3 + 1] ELSE 'terminal' END AS result,
    CASE kind WHEN 'send_email' THEN NULL WHEN 'charge_card' THEN ['declined', 'gateway', 'void'][id % 3 + 1] ELSE 'no handler or member ''' || kind || '''' END AS error, CASE WHEN kind = 'send_email' THEN least(id % 150, 100) END AS progress FROM jobs WHERE state = 'running'"""))
def _(spark, sf):
    claimed = X.jobs(spark, sf).filter("state = 'running'").select("id", "kind", F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")).alias("args"), "attempt", "run_lease")
    return W.perform(claimed, REGISTRY).select("id", "result", "error", "progress")


@query("a15_cancel_events", X.jobs_sql("SELECT 'cancel' AS channel, '{\"job_id\":' || id || ',\"run_lease\":' || run_lease || '}' AS payload FROM jobs WHERE state IN ('running', 'waiting_external') AND queue = 'building'"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    return U.cancel_events(T.cancel(j, F.col("queue") == "building", X.as_of()), X.as_of()).select("channel", "payload")


@query("a19_metrics", X.jobs_sql("""SELECT queue, metric, value FROM (SELECT queue, count(*) FILTER (WHERE state = 'available')::DOUBLE AS "jobs.available", count(*) FILTER (WHERE state = 'running')::DOUBLE AS "jobs.running", count(*) FILTER (WHERE state = 'completed')::DOUBLE AS "jobs.completed",
    count(*) FILTER (WHERE state = 'failed')::DOUBLE AS "jobs.failed", count(*) FILTER (WHERE state = 'cancelled')::DOUBLE AS "jobs.cancelled", sum(attempt)::DOUBLE AS "jobs.attempts", sum(date_diff('second', run_at, finalized_at)) FILTER (WHERE state IN ('completed', 'failed', 'cancelled'))::DOUBLE AS "jobs.seconds_to_finish",
    coalesce(max(date_diff('second', run_at, :now)) FILTER (WHERE state = 'available'), 0)::DOUBLE AS "queue.lag_seconds" FROM jobs GROUP BY queue) UNPIVOT (value FOR metric IN (COLUMNS(* EXCLUDE queue)))"""))
def _(spark, sf):
    return U.metrics(X.jobs(spark, sf), X.as_of())


# Inserts by files: texts with quotes, commas, line feeds and nulls make the round trip.
def _odd(j):
    text = F.when(F.col("id") % 5 == 0, F.lit('say "hi", twice')).when(F.col("id") % 5 == 1, F.lit("two\nlines")).when(F.col("id") % 5 == 2, F.lit(None)).when(F.col("id") % 5 == 3, F.lit("")).otherwise(F.lit("plain"))
    return j.select(F.col("id").alias("ord"), "kind", text.alias("note"), F.when(F.col("id") % 2 == 0, F.col("created_at")).alias("run_at"))


ODD = "CASE id % 5 WHEN 0 THEN 'say \"hi\", twice' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'plain' END"


@query("a08_csv_round_trip", X.jobs_sql(f"SELECT id AS ord, kind, {ODD} AS note FROM jobs"))
def _(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    I.write_csv(_odd(X.jobs(spark, sf)), path)
    return I.read_csv(spark, path, "ord long, kind string, note string, run_at timestamp_ntz").select("ord", "kind", "note")


@query("a06_copy_in", X.jobs_sql(f"SELECT 5000 + row_number() OVER (ORDER BY id) AS id, kind, {ODD} AS note, CASE WHEN id % 2 = 0 THEN 'scheduled' ELSE 'available' END AS state, 25 AS max_attempts FROM jobs WHERE state = 'failed'"))
def _(spark, sf):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    I.write_csv(_odd(X.jobs(spark, sf).filter("state = 'failed'")), path)
    return I.copy_in(spark, path, "ord long, kind string, note string, run_at timestamp_ntz", X.as_of(), 5000).select("id", "kind", "note", "state", "max_attempts")


@query("a10_enqueue_ready", X.jobs_sql("SELECT id AS job_id, queue, 100 + row_number() OVER (PARTITION BY queue, priority, id % 3 ORDER BY id) - 1 AS lane_seq FROM jobs WHERE state = 'scheduled' AND created_at <= :now AND id % 2 = 0"))
def _(spark, sf):
    j = X.jobs(spark, sf).filter("state = 'scheduled'")
    rows = I.prepare(j.select("id", "kind", "queue", "priority", (F.col("id") % 3).alias("enqueue_shard"), F.when(F.col("id") % 2 == 0, F.col("created_at")).otherwise(plus(X.as_of(), 60)).alias("run_at")), X.as_of())
    heads = j.select("queue", "priority", (F.col("id") % 3).alias("enqueue_shard"), F.lit(100).cast("long").alias("next_seq")).distinct()
    return I.enqueue_ready(rows, heads, 2, 9, X.as_of())[0].select("job_id", "queue", "lane_seq")


@query("a03_insert_one", X.jobs_sql("SELECT id, kind, queue, state, priority, max_attempts FROM jobs UNION ALL SELECT 10000001, 'greet', 'mail', 'available', 2, 25"))
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "kind", "queue", "state", "priority", "max_attempts", "run_at")
    return I.insert_one(j, "greet", "{}", X.as_of(), 10_000_000, queue="mail").drop("run_at")


@query("a20_jsonl_round_trip", X.jobs_sql("SELECT id, kind, priority, created_at::VARCHAR AS created_at FROM jobs"))
def _(spark, sf):
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    I.write_jsonl(X.jobs(spark, sf).select("id", "kind", "priority", "created_at"), path)
    return plain(spark.read.schema("id long, kind string, priority int, created_at timestamp_ntz").json(path))


# Values.
@query("d16_fractional_lag", X.jobs_sql("SELECT queue, (epoch_us(:now) - epoch_us(min(run_at + to_milliseconds(id % 997)))) / 1000000.0 AS lag_seconds FROM jobs WHERE state = 'available' GROUP BY queue"))
def _(spark, sf):
    j = X.jobs(spark, sf).withColumn("run_at", F.timestamp_add("MICROSECOND", F.col("id") % 997 * 1000, F.col("run_at")))
    return R.queue_health(j, X.as_of()).filter("gauge = 'lag_seconds'").select("queue", F.col("value").alias("lag_seconds"))


@query("d0_8_merged_counters", X.jobs_sql("SELECT queue, sum(greatest(a, b)) AS n FROM (SELECT queue, kind, count(*) AS a, count(*) FILTER (WHERE id % 2 = 0) * 2 AS b FROM jobs GROUP BY ALL) GROUP BY queue"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    one = j.groupBy("queue", "kind").agg(F.count("*").alias("n"))
    two = j.filter("id % 2 = 0").groupBy("queue", "kind").agg((F.count("*") * 2).alias("n"))
    return R.merged_counts(one, two, ["queue", "kind"]).groupBy("queue").agg(F.sum("n").alias("n"))


def _json(spark, sf):
    """A JSON object of each job: text, number, array, object and null members."""
    return X.jobs(spark, sf).select("id", F.to_json(F.struct(F.col("kind").alias("k"), F.col("id").alias("n"), "tags", F.struct("queue").alias("o"), F.when(F.col("id") % 2 == 0, F.col("state")).alias("s"))).alias("j"))


JS = "js AS (SELECT id, CASE WHEN id % 2 = 0 THEN to_json({'k': kind, 'n': id, 'tags': tags, 'o': {'queue': queue}, 's': state}) ELSE to_json({'k': kind, 'n': id, 'tags': tags, 'o': {'queue': queue}}) END AS j FROM jobs)"


@query("d23_json_members", X.jobs_sql("SELECT id, json_exists(j, '$.s') AS has_s, json_contains(j->'tags', '\"seg-3\"') AS has_tag, (j->>'$.o') AS o, CASE WHEN id % 2 = 0 THEN j->>'$.s' END AS s FROM js", JS))
def _(spark, sf):
    j = F.col("j")
    return _json(spark, sf).select("id", S.json_has(j, "s").alias("has_s"), S.json_has(S.json_member(j, "tags"), "seg-3").alias("has_tag"), S.json_member(j, "o").alias("o"), S.json_member(j, "s").alias("s"))


@query("d23_json_changes", X.jobs_sql("SELECT id, id + 1 AS n, 'x' AS k, 1::BIGINT AS extra, list_sort(json_keys(j)).list_filter(lambda c: c <> 'tags').list_append('extra').list_sort().array_to_string(',') AS keys FROM js", JS))
def _(spark, sf):
    out = S.json_concat(S.json_without(F.col("j"), "tags"), F.to_json(F.struct((F.col("id") + 1).alias("n"), F.lit("x").alias("k"))))
    part = lambda c: F.get_json_object("out", f"$.{c}")
    j = _json(spark, sf).select("id", S.json_put(out, "extra", F.lit("1")).alias("out"))
    return j.select("id", part("n").cast("long").alias("n"), part("k").alias("k"), part("extra").cast("long").alias("extra"), F.array_join(F.array_sort(S.json_keys(F.col("out"))), ",").alias("keys"))


@query("d24_json_each", X.jobs_sql("SELECT id, key, json_extract_string(j, '$.' || key) AS value FROM (SELECT id, j, unnest(json_keys(j)) AS key FROM js)", JS))
def _(spark, sf):
    return _json(spark, sf).select("id", F.explode(S.json_each_text(F.col("j"))).alias("e")).select("id", "e.key", "e.value")


@query("d24_json_kinds", X.jobs_sql("SELECT id, CASE json_type(j->'n') WHEN 'UBIGINT' THEN 'number' ELSE '?' END AS n, lower(json_type(j->'tags')) AS tags, lower(json_type(j->'o')) AS o, 'string' AS k, json_array_length(j->'tags')::BIGINT AS size FROM js", JS))
def _(spark, sf):
    kind = lambda c: S.json_typeof(F.get_json_object("j", f"$.{c}")).alias(c)
    text = F.concat(F.lit('"'), F.get_json_object("j", "$.k"), F.lit('"'))
    return _json(spark, sf).select("id", kind("n"), kind("tags"), kind("o"), S.json_typeof(text).alias("k"), F.json_array_length(F.get_json_object("j", "$.tags")).cast("long").alias("size"))


@query("d25_payload_parts", X.jobs_sql("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags, nullif(n_errors, 0) AS errors FROM jobs"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    p = j.select("id", F.concat(F.lit('{"tags":'), F.when(F.col("id") % 3 == 0, F.lit('"none"')).otherwise(F.to_json("tags")), F.lit(',"errors":'), F.to_json("errors"), F.lit("}")).alias("p"))
    errors = F.size(S.json_errors(S.json_member(F.col("p"), "errors")))
    return p.select("id", F.array_join(S.json_tags(F.col("p")), ",").alias("tags"), F.when(errors > 0, errors).alias("errors"))


@query("d33_error_entries", X.jobs_sql("SELECT id, CASE WHEN id % 4 = 1 THEN NULL ELSE (id % 7)::INTEGER END AS attempt, 'boom' AS error, CASE WHEN id % 4 <> 2 THEN run_at::VARCHAR END AS at, id % 4 = 3 AS terminal FROM jobs"))
def _(spark, sf):
    k = F.col("id")
    attempt = F.when(k % 4 == 1, F.lit('"bad"')).otherwise((k % 7).cast("string"))
    at = F.when(k % 4 == 2, F.lit("soon")).otherwise(F.date_format(F.col("run_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    entry = F.concat(F.lit('[{"attempt":'), attempt, F.lit(',"error":"boom","at":"'), at, F.when(k % 4 == 3, F.lit('","terminal":true}]')).otherwise(F.lit('"}]')))
    e = S.json_errors(entry)[0]
    return X.jobs(spark, sf).select("id", e["attempt"].alias("attempt"), e["error"].alias("error"), e["at"].cast("timestamp_ntz").cast("string").alias("at"), e["terminal"].alias("terminal"))


@query("d28_nul_free", X.jobs_sql("SELECT id, id % 4 IN (1, 2) AS bad FROM jobs"))
def _(spark, sf):
    k = F.col("id") % 4
    raw = F.when(k == 1, F.lit('{"a":{"b":["x\\u0000"]}}')).when(k == 2, F.concat(F.lit('{"k'), F.char(F.lit(0)), F.lit('":1}'))).when(k == 3, F.lit('{"a":"\\u0001"}')).otherwise(F.lit("{}"))
    return X.jobs(spark, sf).select("id", S.has_nul(raw).alias("bad"))


@query("d05_canonical_json", X.jobs_sql("SELECT id, '{\"a\":{\"c\":null,\"d\":[' || id || ',2]},\"b\":\"' || kind || '\"}' AS canonical FROM jobs"))
def _(spark, sf):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def canonical(rows: pa.Array) -> pa.Array:
        return pa.array([blake.canonical_json(json.loads(x)) for x in rows.to_pylist()], pa.string())

    raw = F.concat(F.lit('{ "b": "'), F.col("kind"), F.lit('", "a": {"d": ['), F.col("id").cast("string"), F.lit(', 2], "c": null}}'))
    return X.jobs(spark, sf).select("id", canonical(raw).alias("canonical"))


@query("d06_descriptor_hash")
def _(spark, sf):
    j = X.jobs(spark, sf).select("id", "queue", "tags")
    digest = blake.hashes(lambda queue, tags: blake.descriptor_json(queue.title(), None, "ops", None, tags, {"z": 1, "a": [2]}))
    return j.select("id", digest("queue", "tags").alias("hash"))


@query("d08_partition_of_key")
def _(spark, sf):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def partition(keys: pa.Array) -> pa.Array:
        return pa.array([blake.partition_hash(k.encode()) % 8 for k in keys.to_pylist()], pa.int32())

    key = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    names = F.array(*[F.lit(blake.partition_name("mail", i)) for i in range(8)])
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), partition(key).alias("partition"))
    return c.withColumn("queue", F.element_at(names, F.col("partition") + 1))


@query("d26_semver", X.jobs_sql("SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN (id % 90) * 1000000 WHEN id % 5 = 2 THEN (id % 90) * 1000000 + (id % 70) * 1000 ELSE (id % 90) * 1000000 + (id % 70) * 1000 + id % 50 END AS rank FROM jobs"))
def _(spark, sf):
    text = lambda n: (F.col("id") % n).cast("string")
    k = F.col("id") % 5
    v = F.when(k == 0, F.concat(F.lit("v"), text(90))).when(k == 1, text(90)).when(k == 2, F.concat_ws(".", text(90), text(70))).when(k == 3, F.concat_ws(".", text(90), text(70), text(50))).otherwise(F.concat(F.concat_ws(".", text(90), text(70), text(50)), F.lit("-rc1")))
    return X.jobs(spark, sf).select("id", S.semver_rank(v).alias("rank"))


@query("d27_kind_names", X.jobs_sql("SELECT id, kind AS snake FROM jobs"))
def _(spark, sf):
    camel = F.array_join(F.transform(F.split("kind", "_"), lambda w: F.initcap(w)), "")
    return X.jobs(spark, sf).select("id", S.snake(camel).alias("snake"))


@query("d31_callback_urls", X.jobs_sql("SELECT id, 'http://h' || (id % 9) || '/x/cb/' || id AS url FROM jobs"))
def _(spark, sf):
    base = F.concat(F.lit("http://h"), (F.col("id") % 9).cast("string"), F.lit("/x"), F.repeat(F.lit("/"), (F.col("id") % 3).cast("int")))
    path = F.concat(F.repeat(F.lit("/"), (F.col("id") % 2).cast("int")), F.lit("cb/"), F.col("id").cast("string"))
    return X.jobs(spark, sf).select("id", S.callback_url(base, path).alias("url"))


@query("t40_callback_rules", X.jobs_sql("SELECT id, CASE WHEN id % 7 = 0 THEN 'ignored' WHEN id % 5 = 0 THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN id % 7 > 0 AND id % 5 > 0 AND id % 3 = 0 THEN id + 1 END AS n FROM jobs"))
def _(spark, sf):
    k = F.col("id")
    payload = F.concat(F.lit('{"n":'), k.cast("string"), F.lit(',"status":"'), F.when(k % 7 == 0, "noise").when(k % 5 == 0, "bad").otherwise("ok"), F.lit('"}'))
    calls = X.jobs(spark, sf).select(
        "id", payload.alias("payload"), F.lit('payload.status != "noise"').alias("callback_filter"), F.lit('payload.status == "bad"').alias("on_fail"), F.when(k % 3 == 0, F.lit("payload.n % 3 == 0")).alias("on_complete"),
        F.when(k % 3 == 0, F.lit('{"n": payload.n + 1}')).alias("transform"), F.lit("complete").alias("default_action"),
    )
    out = rules.resolve_table(calls)
    return out.select("id", "outcome", F.when((F.col("outcome") == "completed") & (k % 3 == 0), F.get_json_object("result", "$.n").cast("long")).alias("n"))

