"""State transitions as functions from one snapshot of the jobs to the next, at an explicit moment.

A transition adds the column changed (true where it acted) and leaves all other rows as they are, so the new snapshot and the changed
rows are one DataFrame. Work that takes a bounded number of rows ranks them by a total order: by queue with a window, or over
all with a top-k whose ids come back as a semi-join. One writer is assumed: a claim is a step of a batch, not a lock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import AGING_BATCH, COMPLETED_RETENTION_S, DLQ_RETENTION_S, FAILED_RETENTION_S, HEARTBEAT_STALE_S, PROMOTE_BATCH, RESCUE_BATCH, TERMINAL, plus



def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def update(jobs: DataFrame, when: Column, sets: dict[str, Column], flag: str = "changed") -> DataFrame:
    """The snapshot with sets where the condition holds. All sets see the old row."""
    hit = F.coalesce(when, F.lit(False))
    old = jobs.drop(flag).withColumn(flag, hit) if flag not in jobs.columns else jobs.withColumn("_hit", hit).withColumn(flag, F.col(flag) | F.col("_hit"))
    test = F.col("_hit") if "_hit" in old.columns else F.col(flag)
    return old.select(*[(F.when(test, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)) for c in old.columns if c != "_hit"])


def first_ids(jobs: DataFrame, when: Column, order: list, limit: int, key: str = "id") -> DataFrame:
    """The ids of the first rows of those that fulfil a condition."""
    return jobs.filter(when).orderBy(*order).limit(limit).select(F.col(key).alias("_id"))


def mark(jobs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """jobs with picked: whether the id is among ids, which a limit bounds; Spark broadcasts them by their size."""
    return jobs.join(ids.withColumn("picked", F.lit(True)), F.col(key) == F.col("_id"), "left").drop("_id").withColumn("picked", F.coalesce("picked", F.lit(False)))


def due(as_of: Column) -> Column:
    return (F.col("state") == "available") & (F.col("run_at") <= as_of)


def claim(jobs: DataFrame, meta: DataFrame, as_of: Column, per_queue: int, deadline_s: int = 300) -> DataFrame:
    """Available jobs that are due, of queues that aren't paused: per queue the first by priority, run_at and id start to run."""
    paused = meta.filter("paused").select(F.col("queue").alias("_paused"))
    # the first of a queue are cut off before the shuffle, so a hot queue's backlog is never sorted in one task
    place = F.row_number().over(Window.partitionBy("queue").orderBy("priority", "run_at", "id"))
    open_ = jobs.filter(due(as_of)).select("id", "queue", "priority", "run_at").join(paused, F.col("queue") == F.col("_paused"), "left_anti")
    first = open_.withColumn("_n", place).filter(F.col("_n") <= per_queue).select(F.col("id").alias("_id"))
    picked = mark(jobs, first)
    sets = {
        "state": F.lit("running"), "attempt": F.col("attempt") + 1, "run_lease": F.col("run_lease") + 1, "attempted_at": as_of, "heartbeat_at": as_of,
        "deadline_at": plus(as_of, deadline_s),
    }
    return update(picked, F.col("picked"), sets).drop("picked")


def claim_lane(ready: DataFrame, heads: DataFrame, spent: DataFrame, as_of: Column, aging_s: int, batch: int) -> DataFrame:
    """One queue-storage claim a queue: of its lanes that of the best aged priority of the first live entry (then the oldest, then the
    lowest shard) gives its first entries in order. spent has places that hold no live entry any more."""
    lane = ["queue", "priority", "enqueue_shard"]
    live = ready.join(heads, lane).filter((F.col("lane_seq") >= F.col("next_claim_seq")) & (F.col("run_at") <= as_of)).drop("next_claim_seq")
    live = live.join(spent.select(*lane, "lane_seq"), [*lane, "lane_seq"], "left_anti")
    first = live.groupBy(*lane).agg(F.min_by(F.struct("run_at", "lane_seq"), "lane_seq").alias("f"))
    waited = F.timestamp_diff("SECOND", F.col("f.run_at"), as_of)
    ranked = first.withColumn("effective", S.effective_priority(F.col("priority"), waited, F.lit(aging_s)))
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("queue").orderBy("effective", "f.run_at", "priority", "enqueue_shard"))).filter("_n = 1")
    chosen = live.join(best.select(*lane, "effective"), lane)
    place = F.row_number().over(Window.partitionBy("queue").orderBy("lane_seq"))
    return chosen.withColumn("ordinal", place).filter(F.col("ordinal") <= batch)


def guarded(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs with the requests' columns where (id, run_lease) match a running job; others get nulls: a stale request does nothing."""
    r = requests.select(F.col("id").alias("_rid"), F.col("run_lease").alias("_rl"), F.struct(*requests.columns).alias("request"))
    cond = (F.col("id") == F.col("_rid")) & (F.col("run_lease") == F.col("_rl")) & (F.col("state") == "running")
    return jobs.join(r, cond, "left").drop("_rid", "_rl")


def complete(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    return update(guarded(jobs, requests), F.col("request").isNotNull(), {"state": F.lit("completed"), "finalized_at": as_of}).drop("request")


def reschedule(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests (id, run_lease, action, delay_s, error, u): snooze gives the attempt back, retry_after waits whole seconds without an
    error entry, retry_backoff waits by the attempt and notes the error. A last attempt fails instead, unless it snoozes."""
    g = guarded(jobs, requests)
    action, has = F.col("request.action"), F.col("request").isNotNull()
    snooze, last = action == "snooze", F.col("attempt") >= F.col("max_attempts")
    failed = ~snooze & last
    delay = F.when(action == "retry_backoff", S.backoff_seconds(F.col("attempt"), F.col("request.u"))).otherwise(F.floor("request.delay_s"))
    noted = failed | (action == "retry_backoff")
    entry = F.struct(F.col("attempt").alias("attempt"), F.col("request.error").alias("error"), as_of.alias("at"), F.lit(False).alias("terminal"))
    sets = {
        "state": F.when(failed, "failed").when(snooze, "scheduled").otherwise("retryable"), "attempt": F.when(snooze, F.greatest(F.col("attempt") - 1, F.lit(0))).otherwise(F.col("attempt")),
        "run_at": F.when(failed, F.col("run_at")).otherwise(plus(as_of, F.floor(delay))), "finalized_at": F.when(snooze, _none("timestamp_ntz")).otherwise(as_of),
        "heartbeat_at": _none("timestamp_ntz"), "deadline_at": _none("timestamp_ntz"), "errors": F.when(noted, F.concat("errors", F.array(entry))).otherwise(F.col("errors")),
    }
    return update(g, has, sets).drop("request")


def promote(jobs: DataFrame, as_of: Column, batch: int = PROMOTE_BATCH) -> DataFrame:
    """Scheduled jobs that are due become available, then retryable ones, batch of each at most; run_at restarts now."""
    out = jobs
    for state in ("scheduled", "retryable"):
        ready = (F.col("state") == state) & (F.col("run_at") <= as_of)
        picked = mark(out, first_ids(jobs, ready, ["run_at", "id"], batch))
        none = _none("timestamp_ntz")
        out = update(picked, F.col("picked"), {"state": F.lit("available"), "run_at": as_of, "heartbeat_at": none, "deadline_at": none, "callback_id": _none("string"), "callback_timeout_at": none}).drop("picked")
    return out


def age_priorities(jobs: DataFrame, as_of: Column, every_s: int, batch: int = AGING_BATCH) -> DataFrame:
    """Available jobs that have waited so long get the next better priority; the first priority is noted once. The oldest go first."""
    old = (F.col("state") == "available") & (F.col("priority") > 1) & (F.col("run_at") <= plus(as_of, -every_s))
    picked = mark(jobs, first_ids(jobs, old, ["run_at", "id"], batch))
    known = F.get_json_object("metadata", "$.original_priority").isNotNull()
    note = F.when(known, F.col("metadata")).otherwise(S.json_merge(F.col("metadata"), F.to_json(F.create_map(F.lit("original_priority"), F.col("priority").cast("string")))))
    return update(picked, F.col("picked"), {"priority": F.col("priority") - 1, "metadata": note}).drop("picked")


def _rescue(jobs: DataFrame, when: Column, order: list, batch: int, why: str, as_of: Column) -> DataFrame:
    picked = mark(jobs, first_ids(jobs, when, order, batch))
    entry = F.struct(F.col("attempt").alias("attempt"), F.lit(why).alias("error"), as_of.alias("at"), F.lit(False).alias("terminal"))
    none = _none("timestamp_ntz")
    sets = {"state": F.lit("retryable"), "finalized_at": as_of, "heartbeat_at": none, "deadline_at": none, "errors": F.concat("errors", F.array(entry))}
    return update(picked, F.col("picked"), sets).drop("picked")


def rescue_stale(jobs: DataFrame, as_of: Column, stale_s: int = HEARTBEAT_STALE_S, batch: int = RESCUE_BATCH) -> DataFrame:
    """Running jobs without a recent heartbeat are retryable at once: run_at stays, and max_attempts isn't asked. No heartbeat at all is not
    stale."""
    return _rescue(jobs, (F.col("state") == "running") & (F.col("heartbeat_at") < plus(as_of, -stale_s)), ["heartbeat_at", "id"], batch, "heartbeat stale", as_of)


def rescue_overdue(jobs: DataFrame, as_of: Column, batch: int = RESCUE_BATCH) -> DataFrame:
    return _rescue(jobs, (F.col("state") == "running") & (F.col("deadline_at") < as_of), ["deadline_at", "id"], batch, "deadline exceeded", as_of)


def rescue_callbacks(jobs: DataFrame, as_of: Column, u: Column, batch: int = RESCUE_BATCH) -> DataFrame:
    """Waits that ran out: fail at the last attempt, else retry after the backoff."""
    late = (F.col("state") == "waiting_external") & (F.col("callback_timeout_at") < as_of)
    picked = mark(jobs, first_ids(jobs, late, ["callback_timeout_at", "id"], batch))
    last = F.col("attempt") >= F.col("max_attempts")
    entry = F.struct(F.col("attempt").alias("attempt"), F.lit("callback timeout").alias("error"), as_of.alias("at"), F.lit(False).alias("terminal"))
    wait = F.floor(S.backoff_seconds(F.col("attempt"), u))
    sets = {
        "state": F.when(last, "failed").otherwise("retryable"), "run_at": F.when(last, F.col("run_at")).otherwise(plus(as_of, wait)), "finalized_at": as_of,
        "callback_id": _none("string"), "callback_timeout_at": _none("timestamp_ntz"), "errors": F.concat("errors", F.array(entry)),
    }
    return update(picked, F.col("picked"), sets).drop("picked")


def claims(jobs: DataFrame) -> DataFrame:
    """The unique claims: of jobs with a key whose mask has their state; the oldest job holds a key that several want."""
    want = jobs.filter(F.col("unique_key").isNotNull() & S.state_in_mask(F.col("unique_states"), F.col("state")))
    return want.groupBy("unique_key").agg(F.min("id").alias("holder"), F.count("*").alias("wanting"))


def settle_conflicts(before: DataFrame, after: DataFrame, as_of: Column) -> DataFrame:
    """after with the rows cancelled that changed into a state whose claim another job holds: one that held it before, else the
    oldest of those that changed. A cancelled row's changed stays true."""
    held = before.join(after.filter("changed").select(F.col("id").alias("_c")), F.col("id") == F.col("_c"), "left_anti")
    held = claims(held).select(F.col("unique_key").alias("_k"), F.col("holder").alias("_holder"))
    wants = F.col("changed") & F.col("unique_key").isNotNull() & S.state_in_mask(F.col("unique_states"), F.col("state"))
    # only rows that want a claim are ranked: jobs without a key, the most, never meet
    want = after.filter(wants).select("id", "unique_key").join(held, F.col("unique_key") == F.col("_k"), "left")
    oldest = want.groupBy("unique_key").agg(F.min("id").alias("_oldest"))
    loses = want.join(oldest, "unique_key").filter(F.col("_holder").isNotNull() | (F.col("id") > F.col("_oldest"))).select(F.col("id").alias("_id"))
    return update(mark(after, loses), F.col("picked"), {"state": F.lit("cancelled"), "finalized_at": as_of}).drop("picked")


def retry(jobs: DataFrame, when: Column, as_of: Column) -> DataFrame:
    """An operator's retry of failed, cancelled or waiting jobs: attempts start anew, now."""
    can = when & F.col("state").isin("failed", "cancelled", "waiting_external")
    none = _none("timestamp_ntz")
    sets = {"state": F.lit("available"), "attempt": F.lit(0), "run_at": as_of, "finalized_at": none, "heartbeat_at": none, "deadline_at": none, "callback_id": _none("string"), "callback_timeout_at": none}
    return update(jobs, can, sets)


def cancel(jobs: DataFrame, when: Column, as_of: Column) -> DataFrame:
    """Cancels what isn't terminal; notify tells which jobs a worker holds and must hear of it."""
    can = when & ~F.col("state").isin(*TERMINAL)
    told = jobs.withColumn("notify", can & F.col("state").isin("running", "waiting_external"))
    none = _none("timestamp_ntz")
    return update(told, can, {"state": F.lit("cancelled"), "finalized_at": as_of, "heartbeat_at": none, "deadline_at": none, "callback_id": _none("string"), "callback_timeout_at": none})


def cancel_unique(jobs: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Cancels one job of a unique key, the oldest that isn't terminal."""
    oldest = first_ids(jobs, (F.col("unique_key") == key) & ~F.col("state").isin(*TERMINAL), ["id"], 1)
    return cancel(mark(jobs, oldest), F.col("picked"), as_of).drop("picked")


def discard_failed(jobs: DataFrame, kind: str) -> DataFrame:
    return jobs.filter(~((F.col("state") == "failed") & (F.col("kind") == kind)))


def drain(jobs: DataFrame, queue: str, as_of: Column) -> DataFrame:
    """Cancels what waits in a queue; running jobs go on."""
    return cancel(jobs, (F.col("queue") == queue) & (F.col("state") != "running"), as_of)


def upsert(table: DataFrame, rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """table with rows put in by key; columns in keep stay as they are where the row was there before."""
    new = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    joined = table.withColumn("_there", F.lit(True)).join(new, F.col(key) == F.col(f"_{key}"), "full")
    came, there = F.col(f"_{key}").isNotNull(), F.coalesce("_there", F.lit(False))
    out = []
    for c in table.columns:
        if c not in rows.columns or c in keep:
            out.append((F.when(there, F.col(c)).otherwise(F.col(f"_{c}")) if c in rows.columns else F.col(c)).alias(c))
        else:
            out.append(F.when(came, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def set_paused(meta: DataFrame, queues: list[str], paused: bool) -> DataFrame:
    rows = meta.sparkSession.createDataFrame([(q, paused) for q in queues], "queue string, paused boolean")
    return upsert(meta, rows, "queue")


def sync_descriptors(table: DataFrame, declared: DataFrame, as_of: Column) -> DataFrame:
    """Declared rows (queue, hash) are put in: last_seen_at moves always, updated_at where the hash differs."""
    d = declared.select(F.col("queue").alias("_q"), F.col("hash").alias("_h"))
    j = table.join(d, F.col("queue") == F.col("_q"), "full")
    seen, same = F.col("_q").isNotNull(), F.col("hash").eqNullSafe(F.col("_h"))
    return j.select(
        F.coalesce("queue", "_q").alias("queue"), F.when(seen, F.col("_h")).otherwise(F.col("hash")).alias("hash"),
        F.when(seen & ~(same & F.col("queue").isNotNull()), as_of).otherwise(F.col("updated_at")).alias("updated_at"), F.when(seen, as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def newest(snapshots: DataFrame, key: str, by: str) -> DataFrame:
    """The latest snapshot of each key."""
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, "_r.*")


def retain(jobs: DataFrame, meta: DataFrame, as_of: Column, batch: int | None = None) -> DataFrame:
    """The snapshot without jobs that were finalized before their queue's time, or the default's. With batch, that many go at most, the
    oldest first."""
    m = meta.select(F.col("queue").alias("_q"), "completed_retention_s", "failed_retention_s")
    j = jobs.join(m, F.col("queue") == F.col("_q"), "left")
    keep_s = F.when(F.col("state") == "completed", F.coalesce("completed_retention_s", F.lit(COMPLETED_RETENTION_S))).otherwise(F.coalesce("failed_retention_s", F.lit(FAILED_RETENTION_S)))
    old = F.col("state").isin(*TERMINAL) & (F.col("finalized_at") < plus(as_of, -keep_s))
    if batch is not None:
        gone = first_ids(j, old, ["finalized_at", "id"], batch)
        return jobs.join(gone, F.col("id") == F.col("_id"), "left_anti")
    return j.filter(~F.coalesce(old, F.lit(False))).select(*jobs.columns)


def move_to_dlq(jobs: DataFrame, as_of: Column, kind=None, queue=None, allow_all: bool = False, reason: str = "operator") -> tuple[DataFrame, DataFrame]:
    """Failed jobs of a kind or queue go to the dead letters: (what stays, the letters). Without either, allow_all must be true."""
    if kind is None and queue is None and not allow_all:
        raise ValueError("a kind or a queue is needed, or allow_all")
    cond = F.col("state") == "failed"
    for c, v in (("kind", kind), ("queue", queue)):
        if v is not None:
            cond = cond & (F.col(c) == v)
    cond = F.coalesce(cond, F.lit(False))
    letters = jobs.filter(cond).withColumn("dlq_reason", F.lit(reason)).withColumn("dlq_at", as_of).withColumn("original_run_lease", F.col("run_lease"))
    return jobs.filter(~cond), letters


def retry_from_dlq(letters: DataFrame, jobs: DataFrame, when: Column, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Letters come back as available jobs, unless another job holds their unique claim: (letters that stay, jobs that came)."""
    held = claims(jobs).select(F.col("unique_key").alias("_k"))
    free = letters.filter(when).join(held, F.col("unique_key") == F.col("_k"), "left_anti")
    first = free.withColumn("_n", F.row_number().over(Window.partitionBy("unique_key", F.when(F.col("unique_key").isNull(), F.col("id"))).orderBy("id"))).filter("_n = 1").drop("_n")
    none = _none("timestamp_ntz")
    back = first.withColumns({"state": F.lit("available"), "attempt": F.lit(0), "run_lease": F.lit(0).cast("long"), "run_at": as_of, "finalized_at": none, "progress": _none("string")}).drop("dlq_reason", "dlq_at", "original_run_lease")
    return letters.join(back.select(F.col("id").alias("_b")), F.col("id") == F.col("_b"), "left_anti"), back


def purge_dlq(letters: DataFrame, kind=None, queue=None, allow_all: bool = False) -> DataFrame:
    if kind is None and queue is None and not allow_all:
        raise ValueError("a kind or a queue is needed, or allow_all")
    cond = F.lit(True)
    for c, v in (("kind", kind), ("queue", queue)):
        if v is not None:
            cond = cond & (F.col(c) == v)
    return letters.filter(~F.coalesce(cond, F.lit(False)))


def retain_dlq(letters: DataFrame, as_of: Column, overrides: DataFrame | None = None, keep_s: int = DLQ_RETENTION_S) -> DataFrame:
    age = F.lit(keep_s)
    rows = letters
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("queue").alias("_q"), "dlq_retention_s"), F.col("queue") == F.col("_q"), "left")
        age = F.coalesce("dlq_retention_s", age)
    return rows.filter(~(F.col("dlq_at") < plus(as_of, -age))).select(*letters.columns)


def heartbeat(jobs: DataFrame, beats: DataFrame, as_of: Column) -> DataFrame:
    return update(guarded(jobs, beats), F.col("request").isNotNull(), {"heartbeat_at": as_of}).drop("request")


def set_priority(jobs: DataFrame, when: Column, priority: int) -> DataFrame:
    """A job that has the priority is left alone; the first priority is noted once."""
    known = F.get_json_object("metadata", "$.original_priority").isNotNull()
    note = F.when(known, F.col("metadata")).otherwise(S.json_merge(F.col("metadata"), F.to_json(F.create_map(F.lit("original_priority"), F.col("priority").cast("string")))))
    return update(jobs, when & (F.col("priority") != priority), {"priority": F.lit(priority), "metadata": note})


def move_queue(jobs: DataFrame, when: Column, queue: str, priority: int | None = None) -> DataFrame:
    """To another queue, perhaps with another priority; the first queue and priority are noted once."""
    new = F.coalesce(F.lit(priority), F.col("priority"))
    notes = F.map_filter(
        F.create_map(F.lit("original_queue"), F.col("queue"), F.lit("original_priority"), F.col("priority").cast("string")),
        lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(F.from_json("metadata", "map<string,string>")), F.array()), k),
    )
    return update(jobs, when & ((F.col("queue") != queue) | (F.col("priority") != new)), {"queue": F.lit(queue), "priority": new, "metadata": S.json_merge(F.col("metadata"), F.to_json(notes))})


def enforce_unique(batch: DataFrame, jobs: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of a batch that may be inserted: the first of a key in the batch, if no job holds the key."""
    want = F.col("unique_key").isNotNull() & S.state_in_mask(F.col("unique_states"), F.col("state"))
    key = F.when(want, F.col("unique_key"))
    w = Window.partitionBy(key, F.when(key.isNull(), F.col(order))).orderBy(order)
    first = batch.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_key IS NULL OR _n = 1").drop("_n")
    return first.join(claims(jobs).select(F.col("unique_key").alias("_held")), F.col("_key") == F.col("_held"), "left_anti").drop("_key")


def callback_external(jobs: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """Calls (callback_id, run_lease or null, action): complete, resume, fail or retry of waiting jobs; retry is not for running ones."""
    c = calls.select(F.col("callback_id").alias("_cb"), F.col("run_lease").alias("_rl"), F.col("action").alias("_do"))
    j = jobs.join(c, F.col("callback_id") == F.col("_cb"), "left").withColumn("_ok", F.col("_cb").isNotNull() & (F.col("_rl").isNull() | (F.col("_rl") == F.col("run_lease"))))
    can = F.col("_ok") & F.when(F.col("_do") == "retry", F.col("state") == "waiting_external").otherwise(F.col("state").isin("running", "waiting_external"))
    do, none = F.col("_do"), _none("timestamp_ntz")
    state = F.when(do == "complete", "completed").when(do == "resume", "running").when(do == "fail", "failed").otherwise("available")
    final = F.when(do.isin("complete", "fail"), as_of)
    sets = {"state": state, "finalized_at": final, "attempt": F.when(do == "retry", 0).otherwise(F.col("attempt")), "run_at": F.when(do == "retry", as_of).otherwise(F.col("run_at")), "callback_id": _none("string"), "callback_timeout_at": none}
    return update(j, can, sets).drop("_cb", "_rl", "_do", "_ok")


def outcomes(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Handler results (id, run_lease, result, delay_s, error) of running jobs: completed, cancel, wait, terminal, or what reschedule does."""
    g = guarded(jobs, results)
    result, none = F.col("request.result"), _none("timestamp_ntz")
    entry = F.struct(F.col("attempt").alias("attempt"), F.col("request.error").alias("error"), as_of.alias("at"), F.lit(True).alias("terminal"))
    direct = result.isin("completed", "cancel", "wait", "terminal")
    state = F.when(result == "completed", "completed").when(result == "cancel", "cancelled").when(result == "wait", "waiting_external").otherwise("failed")
    sets = {"state": state, "finalized_at": F.when(result == "wait", none).otherwise(as_of), "heartbeat_at": none, "deadline_at": none, "errors": F.when(result == "terminal", F.concat("errors", F.array(entry))).otherwise(F.col("errors"))}
    first = update(g, direct, sets).drop("request")
    actions = {"retryable": "retry_backoff", "retry_after": "retry_after", "snooze": "snooze"}
    action = reduce(lambda a, kv: F.when(F.col("result") == kv[0], kv[1]).otherwise(a), actions.items(), F.lit(None).cast("string"))
    rest = results.withColumn("action", action).filter("action IS NOT NULL").withColumn("u", F.lit(0.0))
    second = reschedule(first.drop("changed"), rest, as_of).withColumnRenamed("changed", "_second")
    return second.join(first.filter("changed").select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left").withColumn("changed", F.col("_second") | F.col("_f").isNotNull()).drop("_second", "_f")


def register_callback(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Requests (id, run_lease, callback_id, timeout_s) of running jobs: the job waits for its callback from now on."""
    none = _none("timestamp_ntz")
    sets = {
        "state": F.lit("waiting_external"), "callback_id": F.col("request.callback_id"), "callback_timeout_at": plus(as_of, F.col("request.timeout_s")), "heartbeat_at": none,
        "deadline_at": none,
    }
    return update(guarded(jobs, requests), F.col("request").isNotNull(), sets).drop("request")


def heartbeat_callback(jobs: DataFrame, ids: DataFrame, timeout_s: int, as_of: Column) -> DataFrame:
    """A callback that reports in has its time anew."""
    j = jobs.join(ids.select(F.col("callback_id").alias("_cb")).distinct(), F.col("callback_id") == F.col("_cb"), "left")
    return update(j, F.col("_cb").isNotNull() & (F.col("state") == "waiting_external"), {"callback_timeout_at": plus(as_of, timeout_s)}).drop("_cb")


def poll_wait(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """What a waiting handler (id, run_lease, callback_id) finds: waiting, resolved, rescheduled, finished or stale."""
    r = requests.select("id", F.col("run_lease").alias("_rl"), F.col("callback_id").alias("_cb"))
    out = r.join(jobs.select("id", "state", "run_lease", "callback_id"), "id", "left")
    same = F.col("run_lease") == F.col("_rl")
    found = (
        F.when(F.col("state").isNull() | ~same, "stale").when((F.col("state") == "waiting_external") & F.col("callback_id").eqNullSafe(F.col("_cb")), "waiting").when(F.col("state") == "running", "resolved")
        .when(F.col("state").isin(*TERMINAL), "finished").otherwise("rescheduled")
    )
    return out.select("id", found.alias("found"))


def fold_terminal_deltas(deltas: DataFrame, rollups: DataFrame, closed: Column) -> tuple[DataFrame, DataFrame]:
    """Deltas (queue, priority, generation, delta) of closed generations go into the rollups (queue, priority, n): (the deltas that
    stay, the new rollups). The sum of both never changes."""
    done = deltas.filter(closed).groupBy("queue", "priority").agg(F.sum("delta").alias("n"))
    new = rollups.unionByName(done).groupBy("queue", "priority").agg(F.sum("n").alias("n")).filter("n <> 0")
    return deltas.filter(~F.coalesce(closed, F.lit(False))), new
