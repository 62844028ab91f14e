"""Registered queries of the remaining scalars, descriptors, callbacks and rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blake
from ..functions import scalars as S
from ..operators import control as C
from ..operators import transitions as T
from ..registry import query
from ..sources import fixtures as X
from .common import plain


@query("d09_partition_names", "SELECT i, CASE WHEN i = 0 THEN 'mail' ELSE 'mail__p' || i END AS name FROM generate_series(0, 7) t(i)")
def _(spark, sf):
    names = F.array(*[F.lit(blake.partition_name("mail", i)) for i in range(8)])
    return spark.range(8).select(F.col("id").alias("i"), F.element_at(names, (F.col("id") + 1).cast("int")).alias("name"))


@query("d11_sequence_next", "SELECT v, v % 2 = 0 AS called, CASE WHEN v % 2 = 0 THEN v + 1 ELSE v END AS next FROM generate_series(0, 50) t(v)")
def _(spark, sf):
    called = F.col("id") % 2 == 0
    return spark.range(51).select(F.col("id").alias("v"), called.alias("called"), S.sequence_next(F.col("id"), called).alias("next"))


@query("d30_traceparents", "SELECT id, lpad(to_hex(id + 1), 32, '0') AS trace FROM generate_series(0, 99) t(id)")
def _(spark, sf):
    trace, span = F.lower(F.lpad(F.hex(F.col("id") + 1), 32, "0")), F.lit("00000000000000ab")
    return spark.range(100).select("id", S.trace_id(S.traceparent(trace, span, F.col("id") % 2 == 0)).alias("trace")).withColumn("trace", F.upper("trace"))


@query("d39_progress", "SELECT p - 50 AS p, greatest(0, least(100, p - 50)) AS shown FROM generate_series(0, 200) t(p)")
def _(spark, sf):
    return spark.range(201).select((F.col("id") - 50).alias("p"), S.progress(F.col("id") - 50).alias("shown"))


@query("a09_array_literals", X.jobs_sql("SELECT id, '{' || array_to_string(list_transform(tags, lambda x: '\"' || x || '\"'), ',') || '}' AS literal FROM jobs WHERE state = 'failed'"))
def _(spark, sf):
    return X.jobs(spark, sf).filter("state = 'failed'").select("id", S.pg_array(F.col("tags")).alias("literal"))


@query("t37_register_callback", X.jobs_sql("SELECT id, 'waiting_external' AS state, 'new-' || id AS callback_id, (:now + INTERVAL 60 SECOND)::VARCHAR AS callback_timeout_at FROM jobs WHERE state = 'running' AND id % 3 > 0"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    asked = j.select("id", F.when(F.col("id") % 3 > 0, F.col("run_lease")).otherwise(-1).alias("run_lease"), F.concat(F.lit("new-"), F.col("id").cast("string")).alias("callback_id"), F.lit(60).alias("timeout_s"))
    return plain(T.register_callback(j, asked, X.as_of()).filter("changed").select("id", "state", "callback_id", "callback_timeout_at"))


@query("t37_heartbeat_callback", X.jobs_sql("SELECT id, (:now + INTERVAL 300 SECOND)::VARCHAR AS callback_timeout_at FROM jobs WHERE state = 'waiting_external' AND id % 2 = 0"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    return plain(T.heartbeat_callback(j, j.filter("id % 2 = 0").select("callback_id"), 300, X.as_of()).filter("changed").select("id", "callback_timeout_at"))


@query("t39_poll_wait", X.jobs_sql("SELECT id, CASE WHEN id % 5 = 0 THEN 'stale' WHEN state = 'waiting_external' THEN 'waiting' WHEN state = 'running' THEN 'resolved' WHEN state IN ('completed', 'failed', 'cancelled') THEN 'finished' ELSE 'rescheduled' END AS found FROM jobs WHERE id % 7 = 0"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    asked = j.filter("id % 7 = 0").select("id", F.when(F.col("id") % 5 == 0, -1).otherwise(F.col("run_lease")).cast("long").alias("run_lease"), "callback_id")
    return T.poll_wait(j, asked)


@query("t57_terminal_rollup", X.jobs_sql("SELECT queue, priority, count(*) AS n FROM jobs WHERE state IN ('completed', 'failed', 'cancelled') GROUP BY ALL"))
def _(spark, sf):
    d = X.jobs(spark, sf).filter("state IN ('completed', 'failed', 'cancelled')").select("queue", "priority", (F.col("id") % 9).alias("generation"), F.lit(1).cast("long").alias("delta"))
    empty = spark.createDataFrame([], "queue string, priority int, n long")
    rest, rolled = T.fold_terminal_deltas(d, empty, F.col("generation") < 6)
    left = rest.groupBy("queue", "priority").agg(F.sum("delta").alias("n"))
    return rolled.unionByName(left).groupBy("queue", "priority").agg(F.sum("n").alias("n"))


@query("t58_prunable_slots", X.jobs_sql("SELECT 'ready' AS ring, slot, slot_generation, count(*) AS rows FROM (SELECT *, id % 4 AS slot, id % 64 // 4 AS slot_generation FROM jobs) GROUP BY ALL HAVING count(*) FILTER (WHERE state = 'running') = 0 AND slot_generation < 12"))
def _(spark, sf):
    rows = X.jobs(spark, sf).select(F.lit("ready").alias("ring"), (F.col("id") % 4).alias("slot"), F.floor(F.col("id") % 64 / 4).alias("slot_generation"), "state")
    ledger = spark.range(13).select(F.lit("ready").alias("ring"), (F.col("id") % 4).alias("slot"), F.col("id").alias("generation"))
    return C.prunable(rows, ledger, F.col("state") == "running")
