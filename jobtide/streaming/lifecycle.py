"""The stream of lifecycle events folded into the latest state of each job, as a batch and as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, job_id long, run_lease long, event_type string"
# The state that each event leaves a job in.
AFTER = {"started": "running", "waiting": "waiting_external", "completed": "completed", "retried": "retryable", "exhausted": "failed", "cancelled": "cancelled", "rescued": "retryable"}


def state_after(event):
    return F.coalesce(*[F.when(event == k, v) for k, v in AFTER.items()])


def fold(events: DataFrame) -> DataFrame:
    """The last event of each job by lease, then time, then number: an event of an older lease is stale and changes nothing."""
    last = F.max(F.struct("run_lease", "ts", "event_id", "event_type"))
    return events.groupBy("job_id").agg(last.alias("m"), F.count("*").alias("events")).select("job_id", "m.run_lease", state_after(F.col("m.event_type")).alias("state"), "events")


def counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events by type in windows of event time; with a watermark where it is given."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def source(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """New Parquet files of events in a folder, as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def run_fold(spark: SparkSession, path: str, checkpoint: str, name: str) -> DataFrame:
    """The fold as a streaming query over all files that are there; its result as a table in memory."""
    q = fold(source(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def dedupe(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Events without those that come again within the horizon."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def lease_state(stream: DataFrame, timeout_ms: int = 90_000) -> DataFrame:
    """Custom state by job: the highest lease seen and its state; late events of older leases are dropped. A job without an event for the
    timeout of event time is reported as stale once."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            lease, event, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], lease, event, True)], columns=["job_id", "run_lease", "event_type", "stale"])
            return
        lease, event, seen = state.get if state.exists else (-1, "", 0)
        for f in frames:
            for r in f.sort_values(["run_lease", "ts", "event_id"]).itertuples(index=False):
                if r.run_lease >= lease:
                    lease, event = int(r.run_lease), r.event_type
                    seen = max(seen, int(r.ts.timestamp() * 1000))
        state.update((lease, event, seen))
        if seen + timeout_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(max(seen + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], lease, event, False)], columns=["job_id", "run_lease", "event_type", "stale"])

    marked = stream.withWatermark("ts", "10 minutes")
    return marked.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, run_lease long, event_type string, stale boolean", "run_lease long, event_type string, seen long", "update", GroupStateTimeout.EventTimeTimeout
    )


def follow_ups(outcomes: DataFrame, specs: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """Rows to enqueue for outcomes (id, kind, outcome): specs maps (outcome, kind) to (kind, queue) of the job that follows. As the body of
    foreachBatch it appends them with the outcome's batch."""
    pairs = outcomes.sparkSession.createDataFrame([(*k, *v) for k, v in specs.items()], "outcome string, kind string, next_kind string, next_queue string")
    return outcomes.join(F.broadcast(pairs), ["outcome", "kind"]).select(F.col("id").alias("parent_id"), F.col("next_kind").alias("kind"), F.col("next_queue").alias("queue"))
