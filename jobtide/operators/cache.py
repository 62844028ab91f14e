"""Cached counts kept up to date by changes: signed deltas, dirty keys, and the plain recount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltas(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What a change of rows (by id) adds to and takes from the counts by keys."""
    gone = old.select(*keys, F.lit(-1).cast("long").alias("n"))
    came = new.select(*keys, F.lit(1).cast("long").alias("n"))
    return gone.unionByName(came).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def apply(counts: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """counts with the deltas; never below zero, and without keys that are at zero."""
    return counts.unionByName(delta).groupBy(*keys).agg(F.greatest(F.sum("n"), F.lit(0)).alias("n")).filter("n > 0")


def recount(jobs: DataFrame, keys: list[str]) -> DataFrame:
    return jobs.groupBy(*keys).agg(F.count("*").alias("n"))


def refresh_dirty(counts: DataFrame, jobs: DataFrame, dirty: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """counts in which only dirty keys are counted anew."""
    d = dirty.select(key).distinct()
    return counts.join(d, key, "left_anti").unionByName(recount(jobs.join(d, key, "left_semi"), keys).select(*counts.columns))
