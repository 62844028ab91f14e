"""What a claim from the ledgers leaves behind: spent entries that it skips, attempt batches, items, compact batches and lease rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import plus
from .numbering import numbered
from .rebuild import LANE, PLACE, multiranges, unpack

#: Lane positions that a block of a range covers: ranges and entries meet by block, in an equi-join.
BLOCK = 1024


def spent(ready: DataFrame, t: dict[str, DataFrame], receipts: bool) -> DataFrame:
    """ready with spent: the entry has a tombstone or lies in a range of an earlier attempt batch; without receipts, also where any
    ledger (claims, closures, completions, leases, done, deferred, dlq, ready) knows the next run of its job."""
    tombs = t["tombstones"].select(*PLACE).distinct().withColumn("_tomb", F.lit(True))
    at = [c for c in PLACE if c != "lane_seq"]
    ranges = t["attempts"].select(*at, F.explode("lane_ranges").alias("r")).select(*at, F.col("r.lo").alias("_lo"), F.col("r.hi").alias("_hi"))
    ranges = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_lo") / BLOCK), F.floor((F.col("_hi") - 1) / BLOCK))))
    rows = ready.withColumn("_block", F.floor(F.col("lane_seq") / BLOCK))
    tried = rows.join(ranges, [*at, "_block"]).filter((F.col("lane_seq") >= F.col("_lo")) & (F.col("lane_seq") < F.col("_hi"))).select(*PLACE).distinct().withColumn("_tried", F.lit(True))
    out = ready.join(tombs, PLACE, "left").join(tried, PLACE, "left")
    known = F.lit(False)
    if not receipts:
        runs = [t[x].select("job_id", "run_lease") for x in ("claims", "closures", "leases", "done", "deferred", "dlq", "ready")]
        runs.append(unpack(t["completions"], ["queue"], ["job_ids", "run_leases"], ["job_id", "run_lease"]).select("job_id", "run_lease"))
        every = reduce(DataFrame.unionByName, runs).distinct().select(F.col("job_id").alias("_job"), F.col("run_lease").alias("_run"))
        out = out.join(every, (F.col("job_id") == F.col("_job")) & (F.col("run_lease") + 1 == F.col("_run")), "left")
        known = F.col("_job").isNotNull()
    flag = F.col("_tomb").isNotNull() | F.col("_tried").isNotNull() | known
    return out.withColumn("spent", flag).select(*ready.columns, "spent")


def skip_spent(marked: DataFrame, heads: DataFrame) -> DataFrame:
    """heads with next: past the entries that are spent from the cursor on without a gap; a spent entry behind a live one moves nothing."""
    ahead = marked.join(heads, LANE).filter(F.col("lane_seq") >= F.col("next_claim_seq"))
    first = ahead.groupBy(*LANE, "next_claim_seq").agg(F.min(F.when(~F.col("spent"), F.col("lane_seq"))).alias("_live"))
    seqs = ahead.filter("spent").join(first, [*LANE, "next_claim_seq"]).filter(F.col("_live").isNull() | (F.col("lane_seq") < F.col("_live")))
    place = F.row_number().over(Window.partitionBy(*LANE).orderBy("lane_seq")) - 1
    prefix = seqs.withColumn("_i", place).filter(F.col("lane_seq") == F.col("next_claim_seq") + F.col("_i"))
    moved = prefix.groupBy(*LANE).agg((F.max("lane_seq") + 1).alias("_next"))
    return heads.join(moved, LANE, "left").select(*LANE, "next_claim_seq", F.coalesce("_next", "next_claim_seq").alias("next"))


def attempt_batches(selected: DataFrame, claim_slot: int, as_of: Column) -> DataFrame:
    """One row for each slot, generation and lane of selected entries: the ranges of what is tried now."""
    keys = ["ready_slot", "ready_generation", *LANE]
    rows = selected.filter("NOT spent")
    sums = rows.groupBy(*keys).agg(F.min("lane_seq").alias("first_lane_seq"), (F.max("lane_seq") + 1).alias("next_lane_seq"), F.count("*").cast("int").alias("claimed_count"))
    return sums.join(multiranges(rows, keys, "lane_seq", "lane_ranges"), keys).withColumns({"claim_slot": F.lit(claim_slot), "claimed_at": as_of})


def claim_items(selected: DataFrame, claim_slot: int, last_receipt: int) -> DataFrame:
    """The claimed entries with their next attempt and run, a receipt each, and their index in the compact batch that they go to. The batch's
    priority is the effective one."""
    keys = ["ready_slot", "ready_generation", "queue", "effective", "enqueue_shard"]
    order = Window.partitionBy(*keys).orderBy("lane_seq", "job_id")
    rows = selected.filter("NOT spent").withColumns({"claim_slot": F.lit(claim_slot), "attempt": F.col("attempt") + 1, "run_lease": F.col("run_lease") + 1, "claim_batch_index": F.row_number().over(order)})
    return numbered(rows, [], F.floor(F.col("job_id") / 65_536), ["job_id"], "receipt_id").withColumn("receipt_id", F.col("receipt_id") + last_receipt)


def compact_batches(items: DataFrame, as_of: Column, deadline_s: int | None) -> DataFrame:
    """Parallel arrays of the items of each slot, generation, queue, effective priority and shard, in the order of their index."""
    keys = ["claim_slot", "ready_slot", "ready_generation", "queue", "effective", "enqueue_shard"]
    columns = ["job_id", "run_lease", "receipt_id", "lane_seq", "attempt", "max_attempts"]
    packed = items.groupBy(*keys).agg(F.count("*").cast("int").alias("claimed_count"), F.sort_array(F.collect_list(F.struct("claim_batch_index", *[F.col(c).alias(f"_{c}") for c in columns]))).alias("_x"))
    ranges = multiranges(items, keys, "receipt_id", "receipt_ranges")
    out = packed.join(ranges, keys).select(*keys, "claimed_count", *[F.col("_x").getField(f"_{c}").alias(f"{c}s") for c in columns], "receipt_ranges")
    return out.withColumns({"deadline_at": F.lit(None).cast("timestamp_ntz") if deadline_s is None else plus(as_of, deadline_s), "claimed_at": as_of})


def lease_rows(selected: DataFrame, lease_slot: int, lease_generation: int, as_of: Column, deadline_s: int) -> DataFrame:
    """The claimed entries as leases, where no receipts are kept."""
    return selected.filter("NOT spent").select(
        F.lit(lease_slot).alias("lease_slot"), F.lit(lease_generation).cast("long").alias("lease_generation"), *[c for c in PLACE if c != "priority"], F.col("effective").alias("priority"), "job_id",
        F.lit("running").alias("state"), (F.col("attempt") + 1).alias("attempt"), (F.col("run_lease") + 1).alias("run_lease"), "max_attempts",
        as_of.alias("heartbeat_at"), plus(as_of, deadline_s).alias("deadline_at"), as_of.alias("attempted_at"),
    )
