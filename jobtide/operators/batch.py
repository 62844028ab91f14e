"""Batch operations: a filter, its items, and chunks of them that are applied with an outcome each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BATCH_CHUNK, BATCH_RETENTION_S, STATES, TERMINAL, plus
from ..sources.storage import cut
from . import transitions as T
from .numbering import numbered
from .reads import job_filter


def materialise(jobs: DataFrame, items: DataFrame, operation_id: int, **filters) -> DataFrame:
    """items with the jobs that match and aren't items yet; a second run adds nothing."""
    new = jobs.filter(job_filter(**filters)).select(F.lit(operation_id).cast("long").alias("operation_id"), F.col("id").alias("job_id"), F.lit("pending").alias("status"))
    return items.unionByName(new.join(items.select("operation_id", "job_id"), ["operation_id", "job_id"], "left_anti"))


def take_chunk(items: DataFrame, operation_id: int, chunk: int = BATCH_CHUNK) -> DataFrame:
    mine = (F.col("operation_id") == operation_id) & (F.col("status") == "pending")
    return items.filter(mine).orderBy("job_id").limit(chunk)


def apply_chunk(jobs: DataFrame, chunk: DataFrame, action: str, as_of: Column, priority: int | None = None, queue: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the new snapshot, the chunk's items with status succeeded, skipped or missing)."""
    picked = T.mark(jobs, chunk.select(F.col("job_id").alias("_id")))
    acts = {
        "retry": lambda j, c: T.retry(j, c, as_of),
        "cancel": lambda j, c: T.cancel(j, c, as_of).drop("notify"),
        "set_priority": lambda j, c: T.set_priority(j, c & ~F.col("state").isin(*TERMINAL), priority),
        "move_queue": lambda j, c: T.move_queue(j, c & ~F.col("state").isin(*TERMINAL), queue, priority),
    }
    after = acts[action](picked, F.col("picked"))
    seen = after.filter("picked").select(F.col("id").alias("job_id"), F.when(F.col("changed"), "succeeded").otherwise("skipped").alias("_s"))
    done = chunk.drop("status").join(seen, "job_id", "left").withColumn("status", F.coalesce("_s", F.lit("missing"))).drop("_s")
    return after.drop("picked"), done.select(*chunk.columns)


def record(items: DataFrame, done: DataFrame) -> DataFrame:
    d = done.select("operation_id", "job_id", F.col("status").alias("_s"))
    return items.join(d, ["operation_id", "job_id"], "left").withColumn("status", F.coalesce("_s", "status")).select(*items.columns)


def cancel_operation(items: DataFrame, operation_id: int) -> DataFrame:
    return items.withColumn("status", F.when((F.col("operation_id") == operation_id) & (F.col("status") == "pending"), "skipped").otherwise(F.col("status")))


def counters(items: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy("operation_id").agg(F.count("*").alias("total"), *map(n, ("pending", "succeeded", "skipped", "missing")))


def retain_operations(operations: DataFrame, as_of: Column, keep_s: int = BATCH_RETENTION_S) -> DataFrame:
    return operations.filter(~F.coalesce(F.col("finished_at") < plus(as_of, -keep_s), F.lit(False)))


#: The states that an action can act on: a filter that asks for others only is refused.
ELIGIBLE = {"retry": {"failed", "cancelled", "waiting_external"}, **{a: set(STATES) - set(TERMINAL) for a in ("cancel", "set_priority", "move_queue")}}


def check(action: str, filters: dict, allow_all: bool = False, **arguments) -> None:
    """Refuses an operation that isn't one, has no filter without allow_all, lacks its arguments or asks for states that it can't act on."""
    if action not in ELIGIBLE:
        raise ValueError(f"no action {action}")
    if not any(v is not None for v in filters.values()) and not allow_all:
        raise ValueError("a batch operation needs a filter, or allow_all")
    states = filters.get("states")
    wrong = {states} - ELIGIBLE[action] if isinstance(states, str) else set(states or ()) - ELIGIBLE[action]
    if wrong:
        raise ValueError(f"{action} doesn't act on {', '.join(sorted(wrong))}")
    if action == "set_priority" and not 1 <= (arguments.get("priority") or 0) <= 4:
        raise ValueError("a priority from 1 to 4 is needed")
    if action == "move_queue" and not arguments.get("queue"):
        raise ValueError("a queue is needed")


def submit(operations: DataFrame, operation_id: int, action: str, filters: dict, as_of: Column, allow_all: bool = False, submitted_by: str | None = None, **arguments) -> DataFrame:
    """operations with one more, pending."""
    check(action, filters, allow_all, **arguments)
    spark = operations.sparkSession
    row = spark.createDataFrame([(operation_id, action, json.dumps(filters, sort_keys=True), json.dumps(arguments, sort_keys=True), "pending", submitted_by)], "id long, action string, filter string, spec string, state string, submitted_by string")
    row = row.withColumn("submitted_at", as_of)
    return operations.unionByName(row.select(*[(F.col(c) if c in row.columns else F.lit(None)).cast(t).alias(c) for c, t in operations.dtypes]))


def listed(operations: DataFrame, state: str | None = None, limit: int = 100) -> DataFrame:
    """The newest operations, of a state where one is asked for; 1 to 1,000 of them."""
    rows = operations.filter(F.col("state") == state) if state else operations
    return rows.orderBy(F.col("submitted_at").desc(), F.col("id").desc()).limit(min(max(limit, 1), 1000))


def found(operations: DataFrame, operation_id: int) -> DataFrame:
    return operations.filter(F.col("id") == operation_id)


def request_cancel(operations: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Operations of ids that aren't over are cancelling; others stay as they are."""
    hit = operations.join(ids.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left")
    can = F.col("_i").isNotNull() & F.col("state").isin("pending", "scanning", "running")
    return hit.select(*[(F.when(can, v).otherwise(F.col(c)).alias(c) if (v := {"state": F.lit("cancelling"), "updated_at": as_of}.get(c)) is not None else F.col(c)) for c in operations.columns])


def claim_next(operations: DataFrame, runner: str, as_of: Column) -> DataFrame:
    """The oldest operation that isn't over is taken by a runner: a pending one starts to scan; started_at is noted once."""
    open_ = operations.filter(F.col("state").isin("pending", "scanning", "running", "cancelling"))
    one = open_.orderBy("submitted_at", "id").limit(1).select(F.col("id").alias("_i"))
    hit = operations.join(F.broadcast(one), F.col("id") == F.col("_i"), "left")
    sets = {"state": F.when(F.col("state") == "pending", "scanning").otherwise(F.col("state")), "started_at": F.coalesce("started_at", as_of), "runner": F.lit(runner), "updated_at": as_of}
    return hit.select(*[(F.when(F.col("_i").isNotNull(), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)) for c in operations.columns])


def scan(jobs: DataFrame, operation_id: int, **filters) -> tuple[DataFrame, DataFrame]:
    """(the items of all matches when the scan begins, one row with total_matched and the largest id)."""
    empty = jobs.sparkSession.createDataFrame([], "operation_id long, job_id long, status string")
    items = materialise(jobs, empty, operation_id, **filters)
    return items, items.agg(F.count("*").alias("total_matched"), F.coalesce(F.max("job_id"), F.lit(0)).alias("max_job_id"))


def finalize(operations: DataFrame, items: DataFrame, as_of: Column, keep_s: int = BATCH_RETENTION_S) -> DataFrame:
    """Operations that run and have no pending item left are completed, those that are cancelling cancelled; their end and how long they are kept
    are noted once. Their counters are those of their items."""
    n = counters(items).withColumnRenamed("operation_id", "_i").withColumnsRenamed({c: f"_{c}" for c in ("total", "pending", "succeeded", "skipped", "missing")})
    j = operations.join(n, F.col("id") == F.col("_i"), "left")
    state = F.when(F.col("state") == "cancelling", "cancelled").when((F.col("state") == "running") & (F.coalesce("_pending", F.lit(0)) == 0), "completed").otherwise(F.col("state"))
    over = state.isin("completed", "cancelled")
    sets = {"state": state, "finished_at": F.when(over, F.coalesce("finished_at", as_of)).otherwise(F.col("finished_at")), "retention_until": F.when(over, F.coalesce("retention_until", plus(as_of, keep_s))).otherwise(F.col("retention_until"))}
    sets |= {c: F.coalesce(f"_{c}", F.lit(0)) for c in ("total", "succeeded", "skipped") if c in operations.columns}
    return j.select(*[(sets[c].alias(c) if c in sets else F.col(c)) for c in operations.columns])


def run(jobs: DataFrame, operation_id: int, action: str, as_of: Column, checkpoint=cut, chunk: int = BATCH_CHUNK, max_chunks: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """The whole operation: (the new snapshot, its items with their outcome and chunk). Arguments of the action go in filters under
    priority_to and queue_to.

    Items are of different jobs, so the chunks, which go in the order of job_id, don't depend on each other: all are applied in one pass over
    the jobs, and an item keeps the number of its chunk. With max_chunks, items of later ones stay pending. checkpoint writes a
    DataFrame and reads it again."""
    extra = {"priority": filters.pop("priority_to", None), "queue": filters.pop("queue_to", None)}
    items = scan(jobs, operation_id, **filters)[0]
    items = numbered(items, [], F.floor(F.col("job_id") / 65_536), ["job_id"], "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / chunk).cast("long")).drop("_n")
    items = checkpoint(items)
    now = items if max_chunks is None else items.filter(F.col("chunk") < max_chunks)
    after, done = apply_chunk(jobs, now, action, as_of, **extra)
    return after.drop("changed"), checkpoint(record(items, done))
