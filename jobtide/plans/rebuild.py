"""Registered queries of the ledgers: each job of the fixture is put into the ledger that its state asks for, and rebuilt from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rebuild as B
from ..operators.numbering import numbered
from ..registry import query
from ..sources import fixtures as X
from ..sources.storage import cut
from .common import plain

#: Where the fixture's jobs lie, by state and id.
CASE = (
    "CASE WHEN state IN ('scheduled', 'retryable') THEN 'deferred' WHEN state = 'available' THEN 'ready' WHEN state = 'waiting_external' THEN 'leases' "
    "WHEN state = 'running' THEN CASE id % 3 WHEN 0 THEN 'leases' WHEN 1 THEN 'claims' ELSE 'batches' END "
    "WHEN state = 'failed' AND id % 32 = 11 THEN 'dlq' WHEN state = 'completed' AND id % 2 = 0 THEN 'completions' ELSE 'done' END"
)


RICH = ["args", "attempt", "run_lease", "max_attempts", "attempted_at", "unique_key", "unique_states", "payload"]


def ledgers(spark, sf, rich: bool = False) -> dict[str, DataFrame]:
    """The ledgers of the fixture; rich ones keep what the view of all columns needs."""
    j = X.lanes(spark, sf).withColumn("home", F.expr(CASE))
    if rich:
        j = j.withColumn("args", F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")))
        j = j.withColumn("payload", F.to_json(F.struct("tags", "errors", F.parse_json("metadata").alias("metadata"), F.when(F.col("id") % 4 == 0, F.struct((F.col("id") % 100).alias("percent"))).alias("progress"))))
    extra_columns = RICH if rich else []
    j = cut(j.withColumnRenamed("id", "job_id"))  # the lanes are computed once, not for each ledger
    j = j.withColumns({"ready_slot": F.col("slot"), "ready_generation": F.floor(F.col("lane_seq") / 64).cast("long"), "claim_slot": (F.col("job_id") % 8).cast("int"), "receipt_id": F.col("job_id") + 1_000_000, "closed_at": F.lit(None).cast("timestamp_ntz")})
    home = lambda *h: j.filter(F.col("home").isin(*h))
    ready = j.filter(~F.col("home").isin("deferred", "dlq")).select("job_id", "kind", "created_at", "run_at", *B.PLACE, *extra_columns)
    # The cursor stands past every entry that isn't available, so lanes are laid out anew: available entries come last.
    lane = j.groupBy(*B.LANE).agg(F.max("lane_seq").alias("top"))
    moved = ready.join(home("ready").select("job_id", F.lit(True).alias("av")), "job_id", "left").join(lane, B.LANE)
    ready = moved.withColumn("lane_seq", F.when(F.col("av"), F.col("lane_seq") + F.col("top")).otherwise(F.col("lane_seq"))).drop("av", "top")
    extra = ready.filter("job_id % 29 = 0 AND lane_seq > 0").withColumn("job_id", -F.col("job_id")).withColumn("lane_seq", F.col("lane_seq") + 1_000_000)
    claims = home("claims")
    dead = claims.limit(0)
    closed = home("done").filter("state = 'completed'").select("claim_slot", "job_id", "run_lease", "receipt_id", "closed_at", *B.PLACE)
    return {
        "ready": ready.unionByName(extra.select(ready.columns)),
        "heads": lane.select(*B.LANE, (F.col("top") + 1).alias("next_claim_seq")),
        "tombstones": extra.select(*B.PLACE),
        "deferred": home("deferred"),
        "leases": home("leases"),
        # Claims of finished jobs stay in the ledger and are shut out by closures, ranges or terminal rows.
        "claims": claims.select(closed.columns).unionByName(closed).unionByName(dead.select(closed.columns)),
        "batches": B.pack(home("batches"), ["claim_slot", "ready_slot", "ready_generation", "queue", "enqueue_shard"], ["lane_seq", "job_id"], ["job_id", "run_lease", "receipt_id", "lane_seq"]),
        "closures": closed.filter("job_id % 2 = 1").select("claim_slot", "job_id", "run_lease"),
        "closing": B.multiranges(closed.filter("job_id % 4 = 0"), ["claim_slot"], "receipt_id", "receipt_ranges"),
        "done": home("done").withColumn("kind", F.when(F.col("job_id") % 3 == 0, F.col("kind"))).withColumn("run_at", F.when(F.col("job_id") % 5 == 0, F.col("run_at"))).withColumn("created_at", F.lit(None).cast("timestamp_ntz")),
        "completions": B.pack(home("completions"), ["ready_slot", "ready_generation", *B.LANE, "finalized_at"], ["lane_seq"], ["job_id", "lane_seq", *(["run_lease", "attempt"] if rich else [])]),
        "done_tombstones": extra.select(*B.PLACE),
        "dlq": home("dlq"),
    }


def _view(spark, sf):
    return B.current_jobs(ledgers(spark, sf))


# Two routes, one answer: the oracle is the snapshot from which the ledgers were written.
SNAPSHOT = "SELECT id AS job_id, kind, queue, state, created_at::VARCHAR AS created_at, run_at::VARCHAR AS run_at, finalized_at::VARCHAR AS finalized_at FROM jobs"
# Deferred and dead-lettered jobs keep their own finalized_at; entries that wait or run have none.


@query("c01_current_jobs", X.jobs_sql(SNAPSHOT))
def _(spark, sf):
    return plain(_view(spark, sf))


@query("c02_current_counts", X.jobs_sql("SELECT queue, kind, state, count(*) AS n FROM jobs GROUP BY ALL"))
def _(spark, sf):
    return _view(spark, sf).groupBy("queue", "kind", "state").agg(F.count("*").alias("n"))


@query("c03_available_leg", X.jobs_sql("SELECT id AS job_id, queue, kind FROM jobs WHERE state = 'available'"))
def _(spark, sf):
    t = ledgers(spark, sf)
    return B.available(t["ready"], t["heads"], t["tombstones"]).select("job_id", "queue", "kind")


@query("c04_lease_leg", X.jobs_sql("SELECT id AS job_id, kind, state FROM jobs WHERE state = 'waiting_external' OR (state = 'running' AND id % 3 = 0)"))
def _(spark, sf):
    t = ledgers(spark, sf)
    return B.leased(t["leases"], t["ready"]).select("job_id", "kind", "state")


@query("c05_open_claims", X.jobs_sql("SELECT id AS job_id, kind, queue FROM jobs WHERE state = 'running' AND id % 3 = 1"))
def _(spark, sf):
    t = ledgers(spark, sf)
    return B.open_claims(*[t[x] for x in ("claims", "closures", "closing", "leases", "done", "deferred", "dlq", "ready")]).select("job_id", "kind", "queue")


@query("c06_open_batch_claims", X.jobs_sql("SELECT id AS job_id, kind, queue FROM jobs WHERE state = 'running' AND id % 3 = 2"))
def _(spark, sf):
    t = ledgers(spark, sf)
    return B.open_batch_claims(*[t[x] for x in ("batches", "closures", "closing", "leases", "done", "deferred", "dlq", "ready")]).select("job_id", "kind", "queue")


@query("c07_terminal_jobs", X.jobs_sql("SELECT id AS job_id, kind, state, run_at::VARCHAR AS run_at, finalized_at::VARCHAR AS finalized_at FROM jobs WHERE state IN ('completed', 'cancelled') OR (state = 'failed' AND id % 32 <> 11)"))
def _(spark, sf):
    t = ledgers(spark, sf)
    return plain(B.terminal_jobs(t["done"], t["ready"], t["completions"], t["done_tombstones"]).select("job_id", "kind", "state", "run_at", "finalized_at"))


@query("c08_range_containment", "SELECT x, (x >= 3 AND x < 7) OR (x >= 10 AND x < 11) OR (x >= 40 AND x < 90) AS held FROM generate_series(0, 99) t(x)")
def _(spark, sf):
    ranges = F.array(*[F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for a, b in ((3, 7), (10, 11), (40, 90))])
    return spark.range(100).select(F.col("id").alias("x"), B.in_ranges(ranges, F.col("id")).alias("held"))


@query("c09_unnest_ordinality", X.jobs_sql("SELECT id, tag, ordinal::INTEGER AS ordinal FROM (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS ordinal FROM jobs WHERE state = 'failed')"))
def _(spark, sf):
    return B.unpack(X.jobs(spark, sf).filter("state = 'failed'"), ["id"], ["tags"], ["tag"])


SEGMENTS = "segs AS (SELECT queue, priority, enqueue_shard, (lane_seq // 64)::BIGINT AS ready_generation, min(lane_seq) AS first_lane_seq, max(lane_seq) + 1 AS next_lane_seq FROM lanes GROUP BY ALL)"
HEADS = "heads AS (SELECT queue, priority, enqueue_shard, (count(*) * 8 // 10)::BIGINT + 1 AS next_claim_seq FROM lanes GROUP BY ALL)"


def _segments(spark, sf):
    l = X.lanes(spark, sf).withColumn("ready_generation", F.floor(F.col("lane_seq") / 64).cast("long"))
    segs = l.groupBy(*B.LANE, "ready_generation").agg(F.min("lane_seq").alias("first_lane_seq"), (F.max("lane_seq") + 1).alias("next_lane_seq")).withColumn("ready_slot", (F.col("ready_generation") % 4).cast("int"))
    heads = l.groupBy(*B.LANE).agg((F.floor(F.count("*") * 8 / 10) + 1).cast("long").alias("next_claim_seq"))
    return segs, heads


@query("c11_segment_at_cursor", X.jobs_sql("SELECT s.queue, s.priority, s.enqueue_shard, (arg_min(ready_generation, next_lane_seq) % 4)::INTEGER AS ready_slot, arg_min(first_lane_seq, next_lane_seq) AS first_lane_seq, min(next_lane_seq) AS next_lane_seq FROM segs s JOIN heads USING (queue, priority, enqueue_shard) WHERE next_lane_seq > next_claim_seq GROUP BY ALL", X.LANES, SEGMENTS, HEADS))
def _(spark, sf):
    return B.next_segment(*_segments(spark, sf))


@query("c12_slot_bounds", X.jobs_sql("SELECT (ready_generation % 4)::INTEGER AS ready_slot, ready_generation, queue, priority, enqueue_shard, max(next_lane_seq) AS bound FROM segs GROUP BY ALL", X.LANES, SEGMENTS))
def _(spark, sf):
    return B.slot_bounds(_segments(spark, sf)[0])


@query("c13_pair_join", X.jobs_sql("SELECT id, state FROM jobs WHERE (id, run_lease) IN (SELECT id, id % 3 + 1 FROM jobs WHERE id % 7 = 0)"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    asked = j.filter("id % 7 = 0").select("id", (F.col("id") % 3 + 1).alias("run_lease"))
    return j.join(asked, ["id", "run_lease"], "left_semi").select("id", "state")


@query("c14_changed_rows", X.jobs_sql("SELECT id, queue, state, queue AS new_queue, CASE WHEN id % 4 = 0 THEN 'cancelled' ELSE state END AS new_state FROM jobs WHERE id % 4 = 0 AND state IS DISTINCT FROM 'cancelled'"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    return B.changed(j, j.withColumn("state", F.when(F.col("id") % 4 == 0, "cancelled").otherwise(F.col("state"))), "id", ["queue", "state"])


@query("c15_orphans", X.jobs_sql("SELECT queue FROM (SELECT DISTINCT queue FROM queue_meta) WHERE queue NOT IN (SELECT queue FROM jobs UNION SELECT queue FROM queue_descriptors)", X.META, X.DESC))
def _(spark, sf):
    known = X.jobs(spark, sf).select("queue").unionByName(X.descriptors(spark).select("queue"))
    return X.queue_meta(spark).select("queue").join(known, "queue", "left_anti")


@query("c16_open_receipts", X.jobs_sql("SELECT count(*) AS running FROM jobs WHERE state = 'running' AND id % 3 > 0"))
def _(spark, sf):
    t = ledgers(spark, sf)
    args = [t[x] for x in ("closures", "closing", "leases", "done", "deferred", "dlq", "ready")]
    return B.open_claims(t["claims"], *args).select("job_id").unionByName(B.open_batch_claims(t["batches"], *args).select("job_id")).agg(F.count("*").alias("running"))


@query("d0_2_signed_deltas", X.jobs_sql("SELECT queue, state, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT queue, state, 1 AS d FROM jobs UNION ALL SELECT queue, state, -1 FROM jobs WHERE id % 2 = 0 OR state = 'failed') GROUP BY ALL HAVING sum(d) <> 0"))
def _(spark, sf):
    j = X.jobs(spark, sf)
    plus = j.select("queue", "state", F.lit(1).cast("long").alias("delta"))
    minus = j.filter("id % 2 = 0 OR state = 'failed'").select("queue", "state", F.lit(-1).cast("long").alias("delta"))
    return B.signed_fold(plus.unionByName(minus), ["queue", "state"])


@query("d0_5_parallel_arrays", X.jobs_sql("SELECT queue, priority, enqueue_shard, string_agg(id, ',' ORDER BY lane_seq, id) AS ids, string_agg(attempt, ',' ORDER BY lane_seq, id) AS attempts FROM lanes WHERE lane_seq <= 8 GROUP BY ALL", X.LANES))
def _(spark, sf):
    return plain(B.pack(X.lanes(spark, sf).filter("lane_seq <= 8"), B.LANE, ["lane_seq", "id"], ["id", "attempt"]))


@query("d0_6_multirange", X.jobs_sql("SELECT queue, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS ranges FROM (SELECT queue, min(id) AS lo, max(id) + 1 AS hi FROM (SELECT queue, id, id - row_number() OVER (PARTITION BY queue ORDER BY id) AS g FROM jobs) GROUP BY queue, g) GROUP BY queue"))
def _(spark, sf):
    m = B.multiranges(X.jobs(spark, sf), ["queue"], "id")
    return m.select("queue", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), ",").alias("ranges"))


@query("d0_7_buckets", X.jobs_sql("SELECT ((id * -7) % 256 + 256) % 256 AS bucket, count(*) AS n FROM jobs GROUP BY ALL"))
def _(spark, sf):
    return B.bucketed(X.jobs(spark, sf).select((F.col("id") * -7).alias("x")), "x")


@query("w01_batch_index", X.jobs_sql("SELECT id, row_number() OVER (PARTITION BY queue, priority, enqueue_shard ORDER BY lane_seq, id)::INTEGER AS n FROM lanes WHERE state = 'available'", X.LANES))
def _(spark, sf):
    from pyspark.sql import Window

    return X.lanes(spark, sf).filter("state = 'available'").select("id", F.row_number().over(Window.partitionBy(*B.LANE).orderBy("lane_seq", "id")).alias("n"))


ISLANDS = "SELECT queue, priority, enqueue_shard, min(lane_seq) AS lo, max(lane_seq) + 1 AS hi, count(*) AS n FROM (SELECT *, lane_seq - row_number() OVER (PARTITION BY queue, priority, enqueue_shard ORDER BY lane_seq) AS g FROM lanes WHERE state = 'completed') GROUP BY queue, priority, enqueue_shard, g"


@query("w02_islands", X.jobs_sql(ISLANDS, X.LANES))
def _(spark, sf):
    return B.islands(X.lanes(spark, sf).filter("state = 'completed'"), B.LANE, "lane_seq")


@query("w03_contiguous_prefix", X.jobs_sql(f"SELECT h.queue, h.priority, h.enqueue_shard, 1::BIGINT AS cur, coalesce(hi, 1) AS next FROM (SELECT DISTINCT queue, priority, enqueue_shard FROM lanes) h LEFT JOIN ({ISLANDS}) i ON i.queue = h.queue AND i.priority = h.priority AND i.enqueue_shard = h.enqueue_shard AND lo = 1", X.LANES))
def _(spark, sf):
    l = X.lanes(spark, sf)
    heads = l.select(*B.LANE).distinct().withColumn("cur", F.lit(1).cast("long"))
    return B.contiguous_prefix(l.filter("state = 'completed'"), heads, B.LANE, "lane_seq", "cur")


@query("w05_paced_slots", X.jobs_sql("SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 25 + 1)::BIGINT AS slot FROM jobs WHERE state = 'scheduled'"))
def _(spark, sf):
    rows = numbered(X.jobs(spark, sf).filter("state = 'scheduled'").select("id"), [], F.floor(F.col("id") / 65_536), ["id"])
    return rows.select("id", (F.floor((F.col("place") - 1) / 25) + 1).cast("long").alias("slot"))


@query("w06_total_beside_rows", X.jobs_sql("SELECT id, count(*) OVER () AS total FROM jobs WHERE state = 'cancelled'"))
def _(spark, sf):
    j = X.jobs(spark, sf).filter("state = 'cancelled'").select("id")
    return j.crossJoin(F.broadcast(j.agg(F.count("*").alias("total"))))  # one row
