"""Periodic schedules as a table: put in, taken out, paused, resumed, triggered, and evaluated at a moment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cron
from ..functions import scalars as S

#: What a declaration sets; the others belong to the table.
DECLARED = ("cron_expr", "timezone", "kind", "queue", "args", "priority", "max_attempts", "tags", "metadata", "missed_fire_policy")


def listed(schedules: DataFrame) -> DataFrame:
    return schedules.orderBy("name")


def put(schedules: DataFrame, declared: DataFrame, as_of: Column) -> DataFrame:
    """schedules with declared ones put in by name; the last fire, the pause and the creation of those that were there stay. Nothing goes."""
    have = [c for c in DECLARED if c in declared.columns and c in schedules.columns]
    d = declared.select("name", *[F.col(c).alias(f"_{c}") for c in have]).withColumn("_new", F.lit(True))
    j = schedules.withColumn("_old", F.lit(True)).join(d, "name", "full")
    values = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in have}
    values |= {"created_at": F.coalesce("created_at", as_of), "updated_at": F.when(F.col("_new"), as_of).otherwise(F.col("updated_at")), "paused": F.coalesce("paused", F.lit(False))}
    return j.select(*[values.get(c, F.col(c)).alias(c) for c in schedules.columns])


def delete(schedules: DataFrame, names: DataFrame) -> DataFrame:
    return schedules.join(names.select("name"), "name", "left_anti").select(*schedules.columns)


def set_paused(schedules: DataFrame, names: DataFrame, paused: bool, as_of: Column, by: str | None = None) -> DataFrame:
    """names paused, with who and when anew each time, or resumed; the last fire stays, so the policy decides what is caught up on."""
    j = schedules.join(names.select("name", F.lit(True).alias("_hit")), "name", "left")
    hit = F.col("_hit").isNotNull()
    sets = {"paused": F.lit(paused), "paused_at": as_of if paused else F.lit(None).cast("timestamp_ntz"), "paused_by": F.lit(by if paused else None).cast("string"), "updated_at": as_of}
    return j.select(*[(F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)) for c in schedules.columns])


def _job(rows: DataFrame, as_of: Column, extra: Column) -> DataFrame:
    note = S.json_concat(F.col("metadata"), extra)
    return rows.select("name", "kind", "queue", "args", F.lit("available").alias("state"), "priority", "max_attempts", as_of.alias("run_at"), note.alias("metadata"), "tags")


def trigger(schedules: DataFrame, names: DataFrame, as_of: Column) -> DataFrame:
    """A job now for each name, paused or not; the schedule itself doesn't move."""
    rows = schedules.join(names.select("name"), "name", "left_semi")
    return _job(rows, as_of, F.to_json(F.struct(F.col("name").alias("cron_name"), F.lit(True).alias("triggered_manually"))))


def evaluate(schedules: DataFrame, now: datetime, limit: int = cron.LIMIT) -> tuple[DataFrame, DataFrame]:
    """A turn of the evaluator: (schedules with their last fires moved on, the jobs of the fires that they owe)."""
    fires = cron.owed_table(schedules, now, limit)
    moved, jobs = cron.enqueue_fires(schedules, fires, schedules.select("name", F.col("last_enqueued_at").alias("seen")))
    rows = jobs.select("name", "fire_at").join(schedules, "name")
    note = S.json_concat(F.col("metadata"), F.to_json(F.struct(F.col("name").alias("cron_name"), F.col("fire_at").cast("string").alias("cron_fire_time"))))
    return moved, rows.select("name", "fire_at", "kind", "queue", "args", F.lit("available").alias("state"), "priority", "max_attempts", note.alias("metadata"), "tags")
