"""Current jobs from append-only ledgers, and the aggregate and window forms that this needs.

Each kind of evidence is a leg; a leg is an equi-join of two ledgers and a chain of anti-joins against what supersedes it, and the legs are
united. A lane's place is (slot, generation, queue, priority, shard, lane_seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

LANE = ["queue", "priority", "enqueue_shard"]
PLACE = ["ready_slot", "ready_generation", *LANE, "lane_seq"]
RUN = ["job_id", "run_lease"]
VIEW = ["job_id", "kind", "queue", "state", "created_at", "run_at", "finalized_at"]


def in_ranges(ranges: Column, x: Column) -> Column:
    """Whether half-open ranges (lo, hi) hold x."""
    return F.exists(ranges, lambda r: (r["lo"] <= x) & (x < r["hi"]))


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The runs of consecutive values by keys: keys, lo, hi (exclusive), n."""
    w = Window.partitionBy(*keys).orderBy(value)
    one = df.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(w))
    return one.groupBy(*keys, "_island").agg(F.min(value).alias("lo"), (F.max(value) + 1).alias("hi"), F.count("*").alias("n")).drop("_island")


def multiranges(df: DataFrame, keys: list[str], value: str, out: str = "ranges") -> DataFrame:
    """The islands of each key as one ordered array of half-open ranges."""
    return islands(df, keys, value).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias(out))


def contiguous_prefix(df: DataFrame, heads: DataFrame, keys: list[str], value: str, cursor: str) -> DataFrame:
    """Where the cursor of each key can go: past the island that begins at it, else it stays."""
    runs = islands(df, keys, value).select(*keys, F.col("lo").alias(cursor), F.col("hi").alias("_hi"))
    return heads.join(runs, [*keys, cursor], "left").select(*keys, cursor, F.coalesce("_hi", cursor).alias("next"))


def pack(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Parallel arrays of columns by keys, all in the same order."""
    items = F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])))
    packed = df.groupBy(*keys).agg(items.alias("_items"))
    return packed.select(*keys, *[F.col("_items").getField(f"_{c}").alias(f"{c}s") for c in columns])


def unpack(df: DataFrame, keep: list[str], arrays: list[str], names: list[str]) -> DataFrame:
    """Parallel arrays as rows, with ordinal from 1."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for a, n in zip(arrays, names, strict=True)])
    out = df.select(*keep, F.posexplode(zipped).alias("_i", "_x"))
    return out.select(*keep, (F.col("_i") + 1).alias("ordinal"), *[F.col(f"_x.{n}").alias(n) for n in names])


def bucketed(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    return df.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def signed_fold(deltas: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """The state of a ledger of signed changes: sums that aren't zero."""
    return deltas.groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


def available(ready: DataFrame, heads: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries at or past their lane's cursor that no tombstone removes. heads has a row a lane."""
    at_head = ready.join(heads, LANE).filter(F.col("lane_seq") >= F.col("next_claim_seq")).drop("next_claim_seq")
    return at_head.join(tombstones.select(*PLACE), PLACE, "left_anti")


def leased(leases: DataFrame, ready: DataFrame) -> DataFrame:
    entry = ready.select(*PLACE, "kind", "created_at", "run_at")
    return leases.select("job_id", "state", "run_lease", *PLACE).join(entry, PLACE)


def _open(claims: DataFrame, closures: DataFrame, leases: DataFrame, *superseding: DataFrame) -> DataFrame:
    out = claims.join(closures.select("claim_slot", *RUN), ["claim_slot", *RUN], "left_anti")
    for other in (leases, *superseding):
        out = out.join(other.select(*RUN), RUN, "left_anti")
    return out


def _not_closed_in_batches(claims: DataFrame, batches: DataFrame, by_slot: bool) -> DataFrame:
    """Without the claims whose receipt lies in a range of a closing batch; by_slot asks for the claim's slot too.

    Ranges are cut at blocks of 1,024 receipts, so that a claim meets only the ranges of its block: an equi-join, no nested loop."""
    block = 1024
    ranges = batches.select("claim_slot", F.explode("receipt_ranges").alias("r")).select("claim_slot", "r.lo", "r.hi")
    ranges = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    c = claims.withColumn("_block", F.floor(F.col("receipt_id") / block)).alias("c")
    r = ranges.alias("r")
    cond = (F.col("c._block") == F.col("r._block")) & (F.col("c.receipt_id") >= F.col("r.lo")) & (F.col("c.receipt_id") < F.col("r.hi"))
    if by_slot:
        cond = cond & (F.col("c.claim_slot") == F.col("r.claim_slot"))
    return c.join(r, cond, "left_anti").drop("_block")


def _live_claims(claims: DataFrame, closures: DataFrame, closing: DataFrame, leases: DataFrame, done: DataFrame, deferred: DataFrame, dlq: DataFrame) -> DataFrame:
    return _not_closed_in_batches(_open(claims.filter("closed_at IS NULL"), closures, leases, done, deferred, dlq), closing, by_slot=False)


def _live_items(batches: DataFrame, closures: DataFrame, closing: DataFrame, leases: DataFrame, done: DataFrame, deferred: DataFrame, dlq: DataFrame) -> DataFrame:
    keep = ["claim_slot", "ready_slot", "ready_generation", "queue", "enqueue_shard"]
    items = unpack(batches, keep, ["job_ids", "run_leases", "receipt_ids", "lane_seqs"], ["job_id", "run_lease", "receipt_id", "lane_seq"])
    return _not_closed_in_batches(_open(items, closures, leases, done, deferred, dlq), closing, by_slot=True)


def open_claims(claims: DataFrame, closures: DataFrame, closing: DataFrame, leases: DataFrame, done: DataFrame, deferred: DataFrame, dlq: DataFrame, ready: DataFrame) -> DataFrame:
    """Row-wise claims that still run: not closed by row, nor by a range of any slot, nor superseded."""
    live = _live_claims(claims, closures, closing, leases, done, deferred, dlq)
    return live.select("job_id", *PLACE).join(ready.select(*PLACE, "kind", "created_at", "run_at"), PLACE)


def open_batch_claims(batches: DataFrame, closures: DataFrame, closing: DataFrame, leases: DataFrame, done: DataFrame, deferred: DataFrame, dlq: DataFrame, ready: DataFrame) -> DataFrame:
    """Claims in batches of parallel arrays that still run; a closing range counts in its own slot only."""
    live = _live_items(batches, closures, closing, leases, done, deferred, dlq)
    key = ["ready_slot", "ready_generation", "queue", "enqueue_shard", "lane_seq", "job_id"]
    return live.select(*key).join(ready.select(*key, "kind", "created_at", "run_at"), key)


def terminal_jobs(done: DataFrame, ready: DataFrame, completions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Narrow terminal rows filled up from their ready entries, and the rows of completion batches, without those that a tombstone removes."""
    entry = ready.select(*PLACE, *[F.col(c).alias(f"r_{c}") for c in ("kind", "created_at", "run_at")])
    narrow = done.join(entry, PLACE, "left").select(
        "job_id", F.coalesce("kind", "r_kind").alias("kind"), "queue", "state", F.coalesce("created_at", "r_created_at").alias("created_at"),
        F.coalesce("run_at", "r_run_at").alias("run_at"), "finalized_at", *PLACE[:2], *PLACE[3:],
    )
    packed = unpack(completions, ["ready_slot", "ready_generation", *LANE, "finalized_at"], ["job_ids", "lane_seqs"], ["job_id", "lane_seq"])
    full = packed.join(entry, PLACE, "left").select(
        "job_id", F.col("r_kind").alias("kind"), "queue", F.lit("completed").alias("state"), F.col("r_created_at").alias("created_at"), F.col("r_run_at").alias("run_at"), "finalized_at", *PLACE[:2], *PLACE[3:]
    )
    return narrow.unionByName(full).join(tombstones.select(*PLACE), PLACE, "left_anti")


def at_places(candidates: DataFrame, ready: DataFrame, columns: list[str]) -> DataFrame:
    """candidates of all legs with the columns of the ready entries at their places, by one join that shuffles ready once. A candidate without
    a priority goes by its job_id; columns that it has itself win; must tells whether it needs an entry."""
    spot = [c for c in PLACE if c != "priority"]
    entry = ready.select(F.col("job_id").alias("e_job"), F.col("priority").alias("e_priority"), *[F.col(c).alias(f"e_{c}") for c in [*spot, *columns]])
    here = F.lit(True)
    for c in spot:
        here = here & (F.col(c) == F.col(f"e_{c}"))
    same = F.when(F.col("priority").isNull(), F.col("job_id") == F.col("e_job")).otherwise(F.col("priority") == F.col("e_priority"))
    found = candidates.join(entry, here & same, "left").filter(F.col("e_job").isNotNull() | ~F.col("must"))
    own = [c for c in candidates.columns if c not in (*columns, "must")]
    return found.select(*own, F.coalesce("priority", "e_priority").alias("at_priority"), *[(F.coalesce(c, f"e_{c}") if c in candidates.columns else F.col(f"e_{c}")).alias(c) for c in columns])


def current_jobs(t: dict[str, DataFrame]) -> DataFrame:
    """All legs over the ledgers ready, heads, tombstones, deferred, leases, claims, batches, closures, closing, done, completions,
    done_tombstones, dlq. The places of all legs but that of the entries which wait meet the ready entries in one join."""
    evidence = [t[x] for x in ("closures", "closing", "leases", "done", "deferred", "dlq")]
    hydrated = ["kind", "created_at", "run_at"]
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    place = {c: t["ready"].schema[c].dataType.simpleString() for c in PLACE}

    def leg(df: DataFrame, state, must: bool, finalized=None) -> DataFrame:
        spot = [F.col(c) if c in df.columns else null(c, place[c]) for c in PLACE]
        mine = [F.col(c) if not must and c in df.columns else null(c, "string" if c == "kind" else "timestamp_ntz") for c in hydrated]
        return df.select("job_id", state.alias("state"), (F.lit(None).cast("timestamp_ntz") if finalized is None else F.col(finalized)).alias("finalized_at"), *spot, *mine, F.lit(must).alias("must"))

    packed = unpack(t["completions"], ["ready_slot", "ready_generation", *LANE, "finalized_at"], ["job_ids", "lane_seqs"], ["job_id", "lane_seq"])
    ended = leg(t["done"], F.col("state"), False, "finalized_at").unionByName(leg(packed, F.lit("completed"), False, "finalized_at"))
    ended = ended.join(t["done_tombstones"].select(*PLACE), PLACE, "left_anti")
    candidates = leg(t["leases"], F.col("state"), True).unionByName(leg(_live_claims(t["claims"], *evidence), F.lit("running"), True)).unionByName(leg(_live_items(t["batches"], *evidence), F.lit("running"), True)).unionByName(ended)
    waiting = available(t["ready"], t["heads"], t["tombstones"]).withColumn("state", F.lit("available")).withColumn("finalized_at", F.lit(None).cast("timestamp_ntz"))
    out = at_places(candidates, t["ready"], hydrated).select(*VIEW)
    for other in (waiting, t["deferred"], t["dlq"].withColumn("state", F.lit("failed"))):
        out = out.unionByName(other.select(*VIEW))
    return out


#: The view of all columns of a job, in the order of the store's own.
FULL = (
    "id", "kind", "queue", "args", "state", "priority", "attempt", "max_attempts", "run_at", "heartbeat_at", "deadline_at", "attempted_at", "finalized_at", "created_at", "errors", "metadata", "tags",
    "unique_key", "unique_states", "callback_id", "callback_timeout_at", "callback_filter", "callback_on_complete", "callback_on_fail", "callback_transform", "run_lease", "progress",
)


def compat_jobs(t: dict[str, DataFrame]) -> DataFrame:
    """All columns of the jobs in five legs: entries that wait, deferred, leased with their attempt's state, terminal (filled up from their entries)
    and dead letters. What an entry keeps in its payload (errors, metadata, tags, progress) is read from it; a callback's result goes
    into the metadata of a leased job."""
    none, rich = "timestamp_ntz", ["kind", "args", "max_attempts", "attempted_at", "created_at", "run_at", "unique_key", "unique_states", "payload"]
    callbacks = ("callback_filter", "callback_on_complete", "callback_on_fail", "callback_transform")

    def full(df: DataFrame, state=None) -> DataFrame:
        have = set(df.columns)
        get = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
        meta = F.coalesce(S.json_member(F.col("payload"), "metadata"), F.lit("{}"))
        if "callback_result" in have:
            meta = F.when(F.col("callback_result").isNull(), meta).otherwise(S.json_put(meta, "_callback_result", F.col("callback_result")))
        values = {
            "id": F.col("job_id"), "state": F.col("state") if state is None else F.lit(state), "errors": S.json_errors(S.json_member(F.col("payload"), "errors")), "metadata": meta,
            "tags": S.json_tags(F.col("payload")), "progress": F.coalesce(get("attempt_progress", "string"), S.json_member(F.col("payload"), "progress")), "callback_id": get("callback_id", "string"),
            **{c: get(c, none) for c in ("heartbeat_at", "deadline_at", "finalized_at", "callback_timeout_at", "attempted_at")}, **{c: get(c, "string") for c in callbacks},
        }
        return df.select(*[values.get(c, F.col(c)).alias(c) for c in FULL])

    waiting = available(t["ready"], t["heads"], t["tombstones"])
    lease = t["leases"].select(
        "job_id", "run_lease", "state", "attempt", *PLACE, "heartbeat_at", "deadline_at", F.col("attempted_at").alias("lease_attempted_at"), F.col("max_attempts").alias("lease_max"), "callback_id", "callback_timeout_at", F.lit(True).alias("must")
    )
    leased_ = at_places(lease, t["ready"], rich).drop("max_attempts", "attempted_at").withColumnsRenamed({"lease_max": "max_attempts", "lease_attempted_at": "attempted_at"})
    leased_ = leased_.join(t["attempt_state"].withColumnRenamed("progress", "attempt_progress"), RUN, "left")
    packed = unpack(t["completions"], ["ready_slot", "ready_generation", *LANE, "finalized_at"], ["job_ids", "lane_seqs", "run_leases", "attempts"], ["job_id", "lane_seq", "run_lease", "attempt"])
    ended_own = ["kind", "args", "max_attempts", "attempted_at", "created_at", "run_at", "unique_key", "unique_states", "payload"]
    kinds = {c: t["ready"].schema[c].dataType.simpleString() for c in ended_own}
    shape = lambda df, state: df.select("job_id", "run_lease", "attempt", state.alias("state"), "finalized_at", *PLACE, *[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ended_own], F.lit(False).alias("must"))
    ended = shape(t["done"], F.col("state")).unionByName(shape(packed, F.lit("completed"))).join(t["done_tombstones"].select(*PLACE), PLACE, "left_anti")
    out = full(waiting.drop("callback_id"), "available")
    for other in (full(t["deferred"].drop("callback_id", "callback_timeout_at", "heartbeat_at", "deadline_at")), full(leased_), full(at_places(ended, t["ready"], rich)), full(t["dlq"].drop("callback_id", "callback_timeout_at", "heartbeat_at", "deadline_at"), "failed")):
        out = out.unionByName(other)
    return out


def delete_job(t: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The ledgers after jobs (id) are deleted: entries that wait and completions in batches get tombstones and stay; deferred, leased,
    terminal and dead-lettered rows go. A terminal row takes its count back: removed has (queue, priority, enqueue_shard, delta)."""
    gone = ids.select(F.col("id").alias("job_id"))
    waiting = available(t["ready"], t["heads"], t["tombstones"]).join(gone, "job_id", "left_semi")
    packed = unpack(t["completions"], ["ready_slot", "ready_generation", *LANE], ["job_ids", "lane_seqs"], ["job_id", "lane_seq"]).join(gone, "job_id", "left_semi")
    ended = t["done"].join(gone, "job_id", "left_semi")
    out = {k: t[k].join(gone, "job_id", "left_anti") for k in ("deferred", "leases", "done", "dlq")}
    out["tombstones"] = t["tombstones"].select(*PLACE).unionByName(waiting.select(*PLACE)).distinct()
    out["done_tombstones"] = t["done_tombstones"].select(*PLACE).unionByName(packed.select(*PLACE)).distinct()
    out["removed"] = ended.select(*LANE).unionByName(packed.select(*LANE)).groupBy(*LANE).agg((-F.count("*")).alias("delta"))
    return {**t, **out}


def next_segment(segments: DataFrame, heads: DataFrame) -> DataFrame:
    """Of each lane the segment that holds or follows its cursor: that of the least next_lane_seq beyond it."""
    beyond = segments.join(heads, LANE).filter(F.col("next_lane_seq") > F.col("next_claim_seq"))
    return beyond.groupBy(*LANE).agg(F.min_by(F.struct("ready_slot", "first_lane_seq", "next_lane_seq"), "next_lane_seq").alias("s")).select(*LANE, "s.*")


def slot_bounds(segments: DataFrame) -> DataFrame:
    return segments.groupBy("ready_slot", "ready_generation", *LANE).agg(F.max("next_lane_seq").alias("bound"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of which a column differs, nulls being values."""
    b = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return old.select(key, *columns).join(b, key).filter(differs)
