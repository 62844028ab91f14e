"""Runtime control as recurrences over ordered rows: token buckets, weighted shares, ring positions, progress."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def default_burst(rate: float, burst: float = 0) -> float:
    return burst if burst > 0 else max(1.0, math.ceil(rate))


def burst_of(rate: Column, burst: Column) -> Column:
    """default_burst by column."""
    return F.when(burst > 0, burst).otherwise(F.greatest(F.lit(1.0), F.ceil(rate).cast("double")))


def token_bucket(arrivals: DataFrame, rate: float, burst: float = 0) -> DataFrame:
    """arrivals (queue, ts, wanted) with granted: whole tokens of a bucket a queue that refills with time up to its burst.

    The state depends on every earlier grant of the queue, so a queue's arrivals are by nature one stream, however hot the queue is: they are
    taken in order as batches, with two numbers kept between them; nothing is gathered."""
    import pandas as pd

    top = default_burst(rate, burst)

    def run(frames):
        now, left, last = None, top, None
        for f in frames:
            given = []
            for r in f.itertuples(index=False):
                if r.queue != now:
                    now, left, last = r.queue, top, r.ts
                left = min(top, left + (r.ts - last).total_seconds() * rate)
                last = r.ts
                take = min(int(r.wanted), math.floor(left + 1e-9))
                left -= take
                given.append(take)
            yield f.assign(granted=pd.Series(given, dtype="int64", index=f.index))

    ordered = arrivals.repartition("queue").sortWithinPartitions("queue", "ts")
    kinds = ", ".join(f"{n} {t}" for n, t in arrivals.dtypes)
    return ordered.mapInPandas(run, f"{kinds}, granted long")


def weighted_grants(demand: DataFrame, total: int) -> DataFrame:
    """demand (queue, weight, wanted, held) with share and granted: of what is free, each contending queue gets up to its fair share, rounded
    up, less what it holds; in the order of queues while anything is free."""
    contending = demand.filter("wanted > 0 OR held > 0")
    every = Window.partitionBy(F.lit(1))  # a row a queue
    share = F.ceil(F.lit(total) * F.col("weight") / F.sum("weight").over(every))
    shared = contending.withColumn("share", share.cast("long")).withColumn("could", F.greatest(F.lit(0), F.least(F.col("wanted"), F.col("share") - F.col("held"))))
    free = F.lit(total) - F.sum("held").over(every)
    before = F.coalesce(F.sum("could").over(every.orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shared.withColumn("granted", F.greatest(F.lit(0), F.least(F.col("could"), free - before)).cast("long")).drop("could")


def reserved_permits(queues: DataFrame, total: int) -> DataFrame:
    """queues (queue, reserved, weight): what is reserved, and what is left for all by weight."""
    rest = F.greatest(F.lit(0), F.lit(total) - F.sum("reserved").over(Window.partitionBy(F.lit(1))))
    return queues.withColumn("overflow_pool", rest.cast("long"))


def effective_settings(queues: DataFrame, overrides: DataFrame) -> DataFrame:
    """Settings with overrides over them; a deadline of 0 turns deadlines off."""
    o = overrides.select("queue", *[F.col(c).alias(f"_{c}") for c in overrides.columns if c != "queue"])
    j = queues.join(o, "queue", "left")
    pick = [F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in o.columns else F.col(c) for c in queues.columns if c != "queue"]
    out = j.select("queue", *pick)
    return out.withColumn("deadline_ms", F.nullif(F.col("deadline_ms"), F.lit(0))) if "deadline_ms" in out.columns else out


def completion_shards(jobs: DataFrame, shards: int, size: int = 512) -> DataFrame:
    """The flush that each completion goes with: shard by id, then 512 at a time in arrival order."""
    sharded = jobs.withColumn("shard", F.pmod("id", F.lit(shards)).cast("int"))
    ranked = numbered(sharded, ["shard"], F.floor(F.unix_micros(F.col("finalized_at").cast("timestamp")) / 600_000_000), ["finalized_at", "id"], "_n")  # pieces of ten minutes
    return ranked.withColumn("flush", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def ring_cursor(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ring").agg(F.max_by("slot", "generation").alias("slot"), F.max("generation").alias("generation"))


def rotate(ledger: DataFrame, slots: int) -> DataFrame:
    """The next entry of each ring."""
    return ring_cursor(ledger).select("ring", F.pmod(F.col("generation") + 1, F.lit(slots)).cast("int").alias("slot"), (F.col("generation") + 1).alias("generation"))


def prunable(rows: DataFrame, ledger: DataFrame, live: Column) -> DataFrame:
    """Slots of older generations that hold no live row, which may be emptied."""
    cursor = ring_cursor(ledger).select("ring", F.col("generation").alias("now"))
    return rows.groupBy("ring", "slot", "slot_generation").agg(F.count_if(live).alias("live"), F.count("*").alias("rows")).join(cursor, "ring").filter("slot_generation < now AND live = 0").drop("now", "live")


def progress_state(updates: DataFrame) -> DataFrame:
    """updates (job_id, generation, percent): the highest generation of a job wins; older ones never move it back."""
    best = updates.groupBy("job_id").agg(F.max(F.struct("generation", "percent")).alias("m"))
    return best.select("job_id", "m.generation", F.least(F.greatest("m.percent", F.lit(0)), F.lit(100)).alias("percent"))


def dedupe_with_horizon(jobs: DataFrame, period_s: int) -> DataFrame:
    """The first job of a key in each bucket of so many seconds."""
    bucket = F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / (period_s * 1_000_000))
    w = Window.partitionBy("unique_key", "bucket").orderBy("created_at", "id")
    keyed = jobs.filter("unique_key IS NOT NULL").withColumn("bucket", bucket)
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
