"""Read-side operators over jobs, catalog tables, runtime instances and dead letters. Each takes DataFrames and, where time counts, as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import LIVE, STATES, TERMINAL, seconds_between
from .numbering import percentile_ranks

HOUR = "INTERVAL 1 HOUR"


def job_filter(states=None, kind=None, queue=None, tag=None, before_id=None, after_id=None, max_id=None, ids=None, finalized_before=None) -> Column:
    """The conjunction of the filters that are given; true for none."""
    parts = []
    if states:
        parts.append(F.col("state").isin(*([states] if isinstance(states, str) else states)))
    if kind is not None:
        parts.append(F.col("kind") == kind)
    if queue is not None:
        parts.append(F.col("queue") == queue)
    if tag is not None:
        parts.append(F.array_contains("tags", tag))
    if before_id is not None:
        parts.append(F.col("id") < before_id)
    if after_id is not None:
        parts.append(F.col("id") > after_id)
    if max_id is not None:
        parts.append(F.col("id") <= max_id)
    if ids is not None:
        parts.append(F.col("id").isin(*ids))
    if finalized_before is not None:
        parts.append(F.col("finalized_at") < finalized_before)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def list_jobs(jobs: DataFrame, limit: int = 100, clamp: bool = False, **filters) -> DataFrame:
    """The newest jobs first; before_id of the last row asks for the next page. With clamp, as over the ledgers, 1 to 1,000 of them."""
    return jobs.filter(job_filter(**filters)).orderBy(F.desc("id")).limit(min(max(limit, 1), 1000) if clamp else max(limit, 0))


def get_job(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.filter(F.col("id") == job_id)


def state_counts(jobs: DataFrame) -> DataFrame:
    """A row for each of the states, zero where no job has it: one row of counts, turned into rows."""
    wide = jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("ordinal"), F.col(s).alias("jobs")) for i, s in enumerate(STATES)])))


def counts_by(jobs: DataFrame, *keys: str) -> DataFrame:
    """One column a state: what the cache of counts holds."""
    return jobs.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def unpivot_counts(wide: DataFrame) -> DataFrame:
    """Sums of the columns of counts_by as rows of state and jobs."""
    return wide.agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in STATES]).unpivot([], STATES, "state", "jobs")


def stale_after(ms: Column) -> Column:
    """Whole seconds after which a thing that reports every ms is stale."""
    return F.greatest((F.floor(F.greatest(ms, F.lit(1000)) / 1000) * 3).cast("int"), F.lit(30))


def live_instances(instances: DataFrame, as_of: Column) -> DataFrame:
    return instances.filter(F.timestamp_add("SECOND", stale_after(F.col("snapshot_interval_ms")), F.col("last_seen_at")) >= as_of)


def descriptor_drift(instances: DataFrame, as_of: Column) -> DataFrame:
    """How many different hashes the live instances declare for a name."""
    return live_instances(instances, as_of).select(F.explode("hashes").alias("h")).groupBy(F.col("h.name").alias("name")).agg(F.count_distinct("h.hash").alias("variants"))


def queue_overviews(jobs: DataFrame, as_of: Column, descriptors: DataFrame, meta: DataFrame, instances: DataFrame) -> DataFrame:
    """One row a queue that any source names. One pass over the jobs gives the counts, the lag and the last hour's completions."""
    running = F.col("state") == "available"
    recent = (F.col("state") == "completed") & (F.col("finalized_at") > as_of - F.expr(HOUR)) & (F.col("finalized_at") <= as_of)
    shown = ["scheduled", "available", "retryable", "running", "failed", "waiting_external"]
    counts = jobs.groupBy("queue").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in shown], F.count_if(recent).alias("completed_last_hour"),
        F.min(F.when(running, F.col("run_at"))).alias("oldest"),
    )
    declared = instances.select(F.explode("hashes.name").alias("queue"))
    names = counts.select("queue").unionByName(descriptors.select("queue")).unionByName(meta.select("queue")).unionByName(declared).distinct()
    drift = descriptor_drift(instances, as_of).withColumnRenamed("name", "queue")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    queued = sum((zero(s) for s in shown if s != "failed"), F.lit(0)).cast("long")
    stale = F.coalesce(F.timestamp_add("SECOND", stale_after(F.coalesce("sync_interval_ms", F.lit(10_000))), F.col("last_seen_at")) < as_of, F.lit(False))
    return (
        names.join(counts, "queue", "left").join(descriptors, "queue", "left").join(drift, "queue", "left").join(meta, "queue", "left")
        .select(
            "queue", "display_name", "owner", stale.alias("descriptor_stale"), (F.coalesce("variants", F.lit(0)) > 1).alias("descriptor_mismatch"),
            queued.alias("total_queued"), *[zero(s).alias(s) for s in shown], zero("completed_last_hour").alias("completed_last_hour"),
            seconds_between(F.col("oldest"), as_of).alias("lag_seconds"), F.coalesce("paused", F.lit(False)).alias("paused"),
        )
    )


def timeseries(jobs: DataFrame, as_of: Column, minutes: int, column: str = "created_at", unit: str = "minute") -> DataFrame:
    """Jobs by minute of a moment and by state, over the last minutes; minutes without jobs have no row."""
    recent = (F.col(column) >= F.timestamp_add("MINUTE", F.lit(-minutes), as_of)) & (F.col(column) <= as_of)
    return jobs.filter(recent).groupBy(F.date_trunc(unit, column).cast("timestamp_ntz").alias("bucket"), "state").agg(F.count("*").alias("jobs"))


def kind_overviews(jobs: DataFrame, as_of: Column, hot_queues_only: bool = False) -> DataFrame:
    """Jobs, queues and the last hour's completions of each kind. hot_queues_only counts queues of jobs that aren't deferred."""
    seen = F.when(~F.col("state").isin("scheduled", "retryable"), F.col("queue")) if hot_queues_only else F.col("queue")
    recent = (F.col("state") == "completed") & (F.col("finalized_at") > as_of - F.expr(HOUR)) & (F.col("finalized_at") <= as_of)
    return jobs.groupBy("kind").agg(F.count("*").alias("job_count"), F.count_distinct(seen).alias("queue_count"), F.count_if(recent).alias("completed_last_hour"))


def distinct_names(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.lit("kind").alias("what"), F.col("kind").alias("name")).unionByName(jobs.select(F.lit("queue").alias("what"), F.col("queue").alias("name"))).distinct()


def descriptors_for(descriptors: DataFrame, names: list[str]) -> DataFrame:
    return descriptors.filter(F.col("queue").isin(*names))


def enrich(jobs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Jobs with their queue's display name and their first priority; descriptors are a small catalog, whose size Spark knows."""
    return jobs.join(descriptors.select("queue", "display_name"), "queue", "left").withColumn("original_priority", S.original_priority(F.col("metadata"), F.col("priority")))


def runtime_instances(instances: DataFrame, as_of: Column) -> DataFrame:
    """Instances with stale, by the rule in milliseconds."""
    limit = F.greatest(F.greatest(F.col("snapshot_interval_ms"), F.lit(1000)) * 3, F.lit(30_000))
    age = F.timestamp_diff("MICROSECOND", F.col("last_seen_at"), as_of) / 1000
    return instances.withColumn("stale", age > limit)


def runtime_overview(instances: DataFrame, as_of: Column) -> DataFrame:
    i, live = runtime_instances(instances, as_of), ~F.col("stale")
    return i.agg(F.count("*").alias("total"), F.count_if(live).alias("live"), F.count_if("stale").alias("stale"), F.count_if(live & F.col("healthy")).alias("healthy"), F.count_if(live & F.col("leader")).alias("leaders"))


def queue_runtime_summary(instances: DataFrame, as_of: Column) -> DataFrame:
    """By queue: instances, live ones, their workers, and whether the live ones agree in configuration.

    A null dlq agrees with either value, which is no equivalence; all agree when they have one max_workers and at most one
    non-null dlq. The configuration shown is that of the live instance with the smallest id."""
    i = runtime_instances(instances, as_of).select("instance_id", "stale", F.inline("queues"))
    live = ~F.col("stale")
    return i.groupBy("queue").agg(
        F.count("*").alias("instances"), F.count_if(live).alias("live"), F.sum(F.when(live, F.col("max_workers"))).alias("live_workers"),
        ((F.count_distinct(F.when(live, F.col("max_workers"))) <= 1) & (F.count_distinct(F.when(live, F.col("dlq"))) <= 1)).alias("config_agrees"),
        F.min_by("max_workers", F.when(live, F.col("instance_id"))).alias("shown_workers"),
    )


def dlq_list(dlq: DataFrame, limit: int = 100, before: tuple | None = None, before_id: int | None = None, kind=None, queue=None) -> DataFrame:
    """Dead letters, newest first. before is the last page's (dlq_at, id); before_id alone bounds the id while the order is by dlq_at."""
    cond = job_filter(kind=kind, queue=queue, before_id=before_id)
    if before is not None:
        cond = cond & (F.struct("dlq_at", "id") < F.struct(F.lit(before[0]).cast("timestamp_ntz").alias("dlq_at"), F.lit(before[1]).cast("long").alias("id")))
    return dlq.filter(cond).orderBy(F.desc("dlq_at"), F.desc("id")).limit(limit)


def dlq_latest(dlq: DataFrame, job_id: int) -> DataFrame:
    return dlq.filter(F.col("id") == job_id).orderBy(F.desc("dlq_at")).limit(1)


def dlq_depth(dlq: DataFrame, queue: str | None = None) -> DataFrame:
    return dlq.filter(job_filter(queue=queue)).agg(F.count("*").alias("depth"))


def dlq_depth_by_queue(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("queue").agg(F.count("*").alias("depth"))


def timeline(jobs: DataFrame) -> DataFrame:
    """A job's events in order of time; equal times keep the order created, scheduled, attempted, errors, finalized."""
    event = lambda n, name, ts, text=None: F.struct(F.lit(n).alias("n"), F.lit(name).alias("event"), F.col(ts).alias("ts"), (text if text is not None else F.lit(None).cast("string")).alias("detail"))
    fixed = F.array(event(0, "created", "created_at"), event(1, "due", "run_at"), event(2, "attempted", "attempted_at"))
    errors = F.transform("errors", lambda e, i: F.struct((i + 3).alias("n"), F.lit("error").alias("event"), e["at"].alias("ts"), e["error"].alias("detail")))
    last = F.array(event(1000, "finalized", "finalized_at", F.col("state")))
    every = jobs.select("id", F.explode(F.concat(fixed, errors, last)).alias("e")).select("id", "e.*").filter("ts IS NOT NULL")
    return every.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("ts", "n"))).drop("n")


def summary(jobs: DataFrame) -> DataFrame:
    """What an operator can do with each job, and its errors."""
    return jobs.select(
        "id", F.col("state").isin("failed", "cancelled", "waiting_external").alias("can_retry"), F.col("state").isin(*LIVE).alias("can_cancel"),
        F.size("errors").cast("long").alias("error_count"), F.try_element_at("errors", F.lit(-1))["error"].alias("latest_error"),
    )


def dump_job(jobs: DataFrame) -> DataFrame:
    """The whole inspection of each job: its row's main columns, its summary, and its events in the timeline's order."""
    events = timeline(jobs).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "ts", "event", "detail"))).alias("timeline"))
    first = jobs.select("id", "kind", "queue", "state", S.original_priority(F.col("metadata"), F.col("priority")).alias("original_priority"))
    return first.join(summary(jobs), "id").join(events, "id")


def dump_run(jobs: DataFrame, attempt: int) -> DataFrame:
    """An attempt of each job that had it: the current one from the row, an earlier one from its first error entry."""
    past = F.try_element_at(F.filter("errors", lambda e: e["attempt"] == attempt), F.lit(1))
    now = F.col("attempt") == attempt
    return jobs.filter(F.col("attempt") >= attempt).select(
        "id", F.lit(attempt).alias("attempt"), F.when(now, F.col("state")).when(past.isNull(), "unknown").when(past["terminal"], "failed").otherwise("retryable").alias("outcome"),
        F.when(now, F.try_element_at("errors", F.lit(-1))["error"]).otherwise(past["error"]).alias("error"),
    )


def unique_candidate(jobs: DataFrame) -> DataFrame:
    """The oldest job of each unique key that isn't terminal."""
    return jobs.filter(F.col("unique_key").isNotNull() & ~F.col("state").isin(*TERMINAL)).groupBy("unique_key").agg(F.min("id").alias("id"))


def batch_preview(jobs: DataFrame, sample: int = 10, **filters) -> DataFrame:
    """How many jobs match, and the first of them."""
    match = jobs.filter(job_filter(**filters))
    first = match.orderBy("id").limit(sample).agg(F.sort_array(F.collect_list("id")).alias("sample"))
    return match.agg(F.count("*").alias("matched"), F.max("id").alias("max_id")).crossJoin(first)


def queue_health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Depth by queue and live state, and the lag, as rows of (queue, gauge, value)."""
    wide = jobs.groupBy("queue").agg(*[F.count_if(F.col("state") == s).cast("double").alias(s) for s in [*LIVE, "failed"]], seconds_between(F.min(F.when(F.col("state") == "available", F.col("run_at"))), as_of).alias("lag_seconds"))
    return wide.unpivot(["queue"], [*LIVE, "failed", "lag_seconds"], "gauge", "value").filter("value IS NOT NULL")


def backlog(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(~F.col("state").isin(*TERMINAL)).alias("backlog"))


def storage_report(jobs: DataFrame, instances: DataFrame, as_of: Column, needed: str = "1.1.0") -> DataFrame:
    """Backlog, live instances and what blocks a change of storage, as one text."""
    low = S.semver_rank(F.col("version")) < S.semver_rank(F.lit(needed))
    live = live_instances(instances, as_of).agg(F.count("*").alias("live"), F.count_if(low).alias("old"))
    return backlog(jobs).crossJoin(live).select(
        "backlog", "live", "old",
        F.concat_ws("; ", F.when(F.col("backlog") > 0, F.format_string("%d jobs are not terminal", "backlog")), F.when(F.col("old") > 0, F.format_string("%d live instances are older than " + needed, "old"))).alias("blockers"),
    )


def cluster_probe(instances: DataFrame, as_of: Column, within_s: int = 90) -> DataFrame:
    recent = F.timestamp_add("SECOND", F.lit(within_s), F.col("last_seen_at")) >= as_of
    return instances.agg(F.count_if(recent).alias("live"), F.count_if(recent & ~F.col("healthy")).alias("unhealthy"))


def ring_authority(instances: DataFrame, as_of: Column, needed: str) -> DataFrame:
    """Fresh instances, those new enough, and those that block."""
    fresh = live_instances(instances, as_of)
    aware = S.semver_rank(F.col("version")) >= S.semver_rank(F.lit(needed))
    return fresh.agg(F.count("*").alias("fresh"), F.count_if(aware).alias("aware"), F.count_if(~F.coalesce(aware, F.lit(False))).alias("blocking"))


def lag_by_queue(jobs: DataFrame, as_of: Column, over_s: float | None = None, top: int | None = None) -> DataFrame:
    out = jobs.filter("state = 'available'").groupBy("queue").agg(seconds_between(F.min("run_at"), as_of).alias("lag_seconds"))
    if over_s is not None:
        out = out.filter(F.col("lag_seconds") > over_s)
    return out.orderBy(F.desc_nulls_last("lag_seconds"), "queue").limit(top) if top else out


def error_ratio(jobs: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Failed among finalized jobs of the last minutes, by queue, over a denominator of 1 at least."""
    recent = jobs.filter((F.col("finalized_at") > F.timestamp_add("MINUTE", F.lit(-minutes), as_of)) & (F.col("finalized_at") <= as_of))
    failed, done = F.count_if(F.col("state") == "failed"), F.count_if(F.col("state").isin("completed", "failed"))
    return recent.groupBy("queue").agg((failed / F.greatest(done, F.lit(1))).alias("error_ratio"))


def dashboard(jobs: DataFrame, meta: DataFrame, as_of: Column) -> DataFrame:
    """The totals of the first row of a dashboard."""
    ago = lambda unit, n: (F.col("finalized_at") > F.timestamp_add(unit, F.lit(-n), as_of)) & (F.col("finalized_at") <= as_of)
    totals = jobs.agg(
        F.count_if(F.col("state").isin(*LIVE)).alias("backlog"), F.count_if((F.col("state") == "completed") & ago("MINUTE", 1)).alias("completed_last_minute"),
        F.count_if((F.col("state") == "failed") & ago("HOUR", 1)).alias("failed_last_hour"),
    )
    return totals.crossJoin(meta.agg(F.count_if("paused").alias("paused_queues")))


def throughput(jobs: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Finalized jobs by minute and queue with state."""
    recent = jobs.filter((F.col("finalized_at") > F.timestamp_add("MINUTE", F.lit(-minutes), as_of)) & (F.col("finalized_at") <= as_of))
    return recent.groupBy(F.date_trunc("minute", "finalized_at").cast("timestamp_ntz").alias("bucket"), F.concat_ws(" · ", "queue", "state").alias("series")).agg(F.count("*").alias("jobs"))


def merged_counts(live: DataFrame, pruned: DataFrame, keys: list[str]) -> DataFrame:
    """Counts that two sources keep, the larger of both: a full join of (keys, n)."""
    a, b = live.withColumnRenamed("n", "a"), pruned.withColumnRenamed("n", "b")
    return a.join(b, keys, "full").select(*keys, F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("long").alias("n"))


def percentiles(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """Three definitions: element floor(n p), element round((n - 1) p), and interpolation between neighbours. Only the rows of the histogram
    cells that hold these ranks are ranked, so no group is sorted in one task."""
    ranked = percentile_ranks(df, value, p, list(keys))
    pick = lambda place: F.max(F.when(F.col("i") == F.least(place, F.col("n") - 1), F.col("v")))
    spot = (F.col("n") - 1) * F.lit(p)
    low, high = pick(F.floor(spot)), pick(F.ceil(spot))
    return ranked.groupBy(*keys).agg(
        pick(F.floor(F.col("n") * F.lit(p))).alias("by_floor"), pick(F.floor(spot + 0.5)).alias("by_round"), (low + (high - low) * (F.max(spot) - F.floor(F.max(spot)))).alias("interpolated")
    )
