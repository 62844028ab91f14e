"""The data model: states, defaults, schemas and the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states in their order, which is also the order of their bits from the left; the first five are claimed by default.
STATES = ["scheduled", "available", "running", "completed", "retryable", "failed", "cancelled", "waiting_external"]
TERMINAL = ["completed", "failed", "cancelled"]
DEFERRED = ["scheduled", "retryable"]
LIVE = [s for s in STATES if s not in TERMINAL]
HOT = [s for s in STATES if s not in DEFERRED]

# Defaults of producers, queues and maintenance.
DEFAULT_PRIORITY, DEFAULT_MAX_ATTEMPTS, DEFAULT_QUEUE = 2, 25, "default"
BACKOFF_CAP_S, BACKOFF_JITTER = 86_400.0, 0.25
AGING_S, HEARTBEAT_STALE_S, RESCUE_BATCH, AGING_BATCH = 60, 90, 500, 1000
PROMOTE_BATCH = 4096
COMPLETED_RETENTION_S, FAILED_RETENTION_S, DLQ_RETENTION_S, BATCH_RETENTION_S = 24 * 3600, 72 * 3600, 30 * 86_400, 90 * 86_400
PREVIEW_ROWS, BATCH_CHUNK = 10, 100


def at(text: str) -> Column:
    """A moment as a timestamp without zone."""
    return F.lit(text).cast("timestamp_ntz")


def plus(ts: Column | str, seconds: Column | int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    n = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_add("SECOND", n.cast("int"), ts)


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    """Seconds with their fraction."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (earlier, later))
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def ordinal(state: Column | str) -> Column:
    """The state's place in STATES, from 0; null for others."""
    s = F.col(state) if isinstance(state, str) else state
    return F.nullif(F.array_position(F.array(*map(F.lit, STATES)), s), F.lit(0)).cast("int") - 1
