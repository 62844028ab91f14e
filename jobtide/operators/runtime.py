"""Steps of the runtime as functions of snapshots: dispatch, heartbeats, maintenance timers with their brakes, claimer leases, one job at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TERMINAL, plus
from . import transitions as T
from .numbering import numbered

# A branch is late beyond 3/2 and on time below 7/10 of its interval, three times in a row; it rests 120 ticks at most, and a
# prune 2^5 ticks at most; a claimer's lease holds 3 seconds, and an owner is idle after half a second.
LATE, ON_TIME, IN_A_ROW, REST_TICKS, PRUNE_LEVEL = 1.5, 0.7, 3, 120, 5
CLAIMER_TTL_MS, CLAIMER_IDLE_MS = 3000, 500


def dispatch(jobs: DataFrame, meta: DataFrame, queues: DataFrame, as_of: Column, deadline_s: int = 300) -> tuple[DataFrame, DataFrame]:
    """One turn of every queue's poll loop: queues (queue, permits, tokens) claim as many due jobs as both allow. (the new snapshot, a row a
    queue: asked, claimed and the tokens given back)."""
    paused = meta.filter("paused").select("queue")
    ask = queues.withColumn("asked", F.greatest(F.least(F.col("permits"), F.floor("tokens")), F.lit(0)).cast("long")).select("queue", "asked")
    open_ = jobs.filter(T.due(as_of)).select("id", "queue", "priority", "run_at").join(paused, "queue", "left_anti").join(ask, "queue")
    most = queues.agg(F.max("permits")).first()[0] or 0  # a literal bound, by which the ranking is cut off before the shuffle
    place = F.row_number().over(Window.partitionBy("queue").orderBy("priority", "run_at", "id"))
    first = open_.withColumn("_n", place).filter(F.col("_n") <= most).filter(F.col("_n") <= F.col("asked"))
    sets = {
        "state": F.lit("running"), "attempt": F.col("attempt") + 1, "run_lease": F.col("run_lease") + 1, "attempted_at": as_of, "heartbeat_at": as_of, "deadline_at": plus(as_of, deadline_s),
    }
    after = T.update(T.mark(jobs, first.select(F.col("id").alias("_id"))), F.col("picked"), sets).drop("picked")
    got = first.groupBy("queue").agg(F.count("*").alias("claimed"))
    ledger = ask.join(got, "queue", "left").select("queue", "asked", F.coalesce("claimed", F.lit(0)).alias("claimed"), (F.col("asked") - F.coalesce("claimed", F.lit(0))).alias("refunded"))
    return after, ledger


def heartbeat_batches(running: DataFrame, progress: DataFrame, size: int) -> DataFrame:
    """running (id, run_lease) in batches of size: those with pending progress (id, generation beyond acked) apart from the others."""
    pending = progress.filter(F.col("generation") > F.col("acked")).select("id", F.lit(True).alias("_p"))
    rows = running.join(pending, "id", "left").withColumn("kind", F.when(F.col("_p"), "progress").otherwise("heartbeat")).drop("_p")
    return numbered(rows, ["kind"], F.floor(F.col("id") / 65_536), ["id"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def due_branches(branches: DataFrame, as_of: Column) -> DataFrame:
    """branches (name, interval_ms, last_run_at) with due and missed, the ticks that went by since the last run beside the one due; a branch
    that never ran is due."""
    since = F.timestamp_diff("MICROSECOND", F.col("last_run_at"), as_of) / 1000
    ticks = F.floor(since / F.col("interval_ms"))
    return branches.withColumn("due", F.col("last_run_at").isNull() | (ticks >= 1)).withColumn("missed", F.greatest(F.coalesce(ticks, F.lit(1)) - 1, F.lit(0)).cast("long"))


def _fold(rows: DataFrame, key: str, order: str, step, start, schema: str) -> DataFrame:
    """step(state, row) -> (state, values) over the rows of a key in order: a stream a key, which keeps one state and gathers nothing."""
    import pandas as pd

    def run(frames):
        now, state = None, None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if getattr(r, key) != now:
                    now, state = getattr(r, key), start
                state, values = step(state, r)
                out.append(values)
            yield f.assign(**{n: pd.Series([v[i] for v in out], index=f.index) for i, n in enumerate(x.split()[0] for x in schema.split(", "))})

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{kinds}, {schema}")


def branch_health(ticks: DataFrame, rest_ticks: int = REST_TICKS) -> DataFrame:
    """ticks (branch, tick, interval_ms, took_ms: what the body takes if it runs) with ran, delayed and resting after each tick.

    A branch whose body overran three times in a row is delayed and rests, as long as twice the body took; a rest takes no sample, and each
    sample counts once. Three in a row on time make it well again; durations between both bounds count for neither."""

    def step(state, r):
        rest, last, over, fine, late = state
        if rest > 0:
            return (rest - 1, last, over, fine, late), (False, late, rest - 1)
        if last is not None:
            if last > LATE * r.interval_ms:
                over, fine = over + 1, 0
                if over >= IN_A_ROW:
                    late = True
                    rest = min(max(-(-2 * last // max(r.interval_ms, 1)), 1), rest_ticks) if rest_ticks else 0
            elif last < ON_TIME * r.interval_ms:
                over, fine = 0, fine + 1
                late = late and fine < IN_A_ROW
            if rest > 0:
                return (rest, None, over, fine, late), (False, late, rest)
        return (0, r.took_ms, over, fine, late), (True, late, 0)

    return _fold(ticks, "branch", "tick", step, (0, None, 0, 0, False), "ran boolean, delayed boolean, resting long")


def prune_backoff(ticks: DataFrame) -> DataFrame:
    """ticks (ring, tick, outcome: pruned, active, blocked or noop, what a prune meets if it runs) with ran, level and skip after each: a
    prune that could not act skips 2^level ticks, one level more each time; success starts over, nothing to do changes nothing."""

    def step(state, r):
        skip, level = state
        if skip > 0:
            return (skip - 1, level), (False, level, skip - 1)
        if r.outcome == "pruned":
            skip, level = 0, 0
        elif r.outcome in ("active", "blocked"):
            level = min(level + 1, PRUNE_LEVEL)
            skip = 1 << level
        return (skip, level), (True, level, skip)

    return _fold(ticks, "ring", "tick", step, (0, 0), "ran boolean, level long, skip long")


def claimer_leases(leases: DataFrame, asks: DataFrame, as_of: Column, most: int) -> DataFrame:
    """leases (queue, claimer_slot, owner, lease_epoch, last_claimed_at, expires_at) after one ask of an owner a queue (asks: queue, owner).

    The owner's own slot is renewed; else it takes a free slot below most, else one that expired or whose owner is idle, the lowest, with the
    next epoch; else it gets none."""
    ms = lambda n: F.timestamp_add("MICROSECOND", F.lit(n * 1000), as_of)
    slots = asks.withColumn("claimer_slot", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("queue", F.col("owner").alias("_me"), "claimer_slot")
    j = slots.join(leases, ["queue", "claimer_slot"], "left")
    stale = (F.col("expires_at") <= as_of) | (F.col("last_claimed_at") <= ms(-CLAIMER_IDLE_MS))
    rank = F.when(F.col("owner") == F.col("_me"), 0).when(F.col("owner").isNull(), 1).when(stale, 2)
    best = j.withColumn("_r", rank).filter("_r IS NOT NULL").groupBy("queue").agg(F.min(F.struct("_r", "claimer_slot", "_me")).alias("b"))
    taken = best.select("queue", F.col("b.claimer_slot").alias("claimer_slot"), F.col("b._me").alias("_new"), F.col("b._r").alias("_r"))
    out = leases.join(taken, ["queue", "claimer_slot"], "full")
    won = F.col("_new").isNotNull()
    epoch = F.when(F.col("_r") == 0, F.col("lease_epoch")).when(F.col("_r") == 2, F.col("lease_epoch") + 1).otherwise(F.lit(0))
    return out.select(
        "queue", "claimer_slot", F.coalesce("_new", "owner").alias("owner"), F.when(won, epoch).otherwise(F.col("lease_epoch")).cast("long").alias("lease_epoch"),
        F.when(won, as_of).otherwise(F.col("last_claimed_at")).alias("last_claimed_at"), F.when(won, ms(CLAIMER_TTL_MS)).otherwise(F.col("expires_at")).alias("expires_at"),
    )


def work_one(jobs: DataFrame, kind: str, result: str, as_of: Column, error: str | None = None, delay_s: int = 0) -> DataFrame:
    """The test harness's step: the first due job of a kind is claimed and gets a handler's result at once."""
    order = ["priority", "run_at", "id"]
    one = T.first_ids(jobs, T.due(as_of) & (F.col("kind") == kind), order, 1)
    running = T.update(T.mark(jobs, one), F.col("picked"), {"state": F.lit("running"), "attempt": F.col("attempt") + 1, "run_lease": F.col("run_lease") + 1, "attempted_at": as_of}).drop("changed")
    results = running.filter("picked").select("id", "run_lease", F.lit(result).alias("result"), F.lit(delay_s).alias("delay_s"), F.lit(error).cast("string").alias("error"))
    return T.outcomes(running.drop("picked"), results, as_of)


def age_out(rows: DataFrame, as_of: Column, keep_s: int, seen: str = "last_seen_at") -> DataFrame:
    """rows that were seen within keep_s seconds, a second at least."""
    return rows.filter(F.col(seen) >= plus(as_of, -max(1, keep_s)))


def configs(reports: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Of reports (queue, fields, dlq) by instance, one row a queue: agrees, whether all are like the first, and the representative's dlq. A
    null dlq agrees with any: the representative is the first report, or the first that matches it and says what its dlq is."""
    first = F.min_by(F.struct(*fields, "dlq"), order)
    joined = reports.join(reports.groupBy("queue").agg(first.alias("_f")), "queue")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_f.{c}"))
    match = same & (F.col("dlq").isNull() | F.col("_f.dlq").isNull() | (F.col("dlq") == F.col("_f.dlq")))
    said = F.min_by("dlq", F.when(match & F.col("dlq").isNotNull(), F.col(order)))
    return joined.groupBy("queue").agg(F.bool_and(match).alias("agrees"), F.coalesce(F.first("_f.dlq"), said).alias("dlq"), *[F.first(f"_f.{c}").alias(c) for c in fields])


def migrate(jobs: DataFrame, requests: DataFrame, claims: DataFrame, as_of: Column, last_id: int) -> tuple[DataFrame, DataFrame]:
    """Running jobs that are rescheduled into the other store: (the jobs that stay, their successors).

    Requests (id, run_lease, delay_s, snooze). Jobs with a callback stay and are rescheduled in place by others. A successor has a fresh id after
    last_id and its predecessor's history; it is cancelled as a duplicate where another job holds its unique claim (unique_key)."""
    r = requests.select(F.col("id").alias("_rid"), F.col("run_lease").alias("_rl"), "delay_s", "snooze")
    mine = (F.col("id") == F.col("_rid")) & (F.col("run_lease") == F.col("_rl")) & (F.col("state") == "running") & F.col("callback_id").isNull() & F.col("callback_timeout_at").isNull()
    taken = jobs.join(r, mine)
    taken = numbered(taken, [], F.floor(F.col("id") / 65_536), ["id"], "_n").withColumnRenamed("id", "old_id")
    held = claims.select(F.col("unique_key").alias("_k")).distinct()
    # of successors with one key the first keeps it
    first = taken.filter("unique_key IS NOT NULL").groupBy("unique_key").agg(F.min("old_id").alias("_first"))
    joined = taken.join(held, F.col("unique_key") == F.col("_k"), "left").join(first, "unique_key", "left")
    duplicate = F.col("unique_key").isNotNull() & (F.col("_k").isNotNull() | (F.col("old_id") > F.col("_first")))
    state = F.when(duplicate, "cancelled").when(F.col("snooze"), "scheduled").otherwise("retryable")
    none = F.lit(None).cast("timestamp_ntz")
    out = joined.withColumns(
        {
            "id": F.lit(last_id) + F.col("_n"), "state": state, "attempt": F.when(F.col("snooze"), F.greatest(F.col("attempt") - 1, F.lit(0))).otherwise(F.col("attempt")),
            "run_at": plus(as_of, F.floor("delay_s")), "finalized_at": F.when(duplicate | ~F.col("snooze"), as_of), "heartbeat_at": none, "deadline_at": none,
        }
    )
    stay = jobs.join(taken.select(F.col("old_id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
    return stay, out.select("old_id", *jobs.columns)


def route(hot: DataFrame, deferred: DataFrame, rows: DataFrame, is_deferred: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables after rows are written through their view: by id, each row leaves where it was and goes to the table of its state."""
    stays = lambda df: df.join(rows.select(F.col("id").alias("_w")), F.col("id") == F.col("_w"), "left_anti")
    return stays(hot).unionByName(rows.filter(~is_deferred).select(*hot.columns)), stays(deferred).unionByName(rows.filter(is_deferred).select(*deferred.columns))


def cancel_events(after: DataFrame, as_of: Column) -> DataFrame:
    """The notices that workers get of cancelled jobs that they hold, to append to a sink; after is what cancel gives."""
    return after.filter("notify").select(F.lit("cancel").alias("channel"), F.to_json(F.struct(F.col("id").alias("job_id"), "run_lease")).alias("payload"), as_of.alias("sent_at"))


def metrics(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Counters and gauges as rows (metric, queue, value), to append to a metric sink."""
    wide = jobs.groupBy("queue").agg(
        *[F.count_if(F.col("state") == s).cast("double").alias(f"jobs.{s}") for s in ("available", "running", *TERMINAL)], F.sum("attempt").cast("double").alias("jobs.attempts"),
        (F.sum(F.when(F.col("state").isin(*TERMINAL), F.timestamp_diff("MICROSECOND", F.col("run_at"), F.col("finalized_at")))) / 1e6).alias("jobs.seconds_to_finish"),
        F.coalesce(F.max(F.when(F.col("state") == "available", F.timestamp_diff("MICROSECOND", F.col("run_at"), as_of))) / 1e6, F.lit(0.0)).alias("queue.lag_seconds"),
    )
    return wide.unpivot(["queue"], None, "metric", "value")
