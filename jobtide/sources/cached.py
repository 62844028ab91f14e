"""Reads that a dashboard repeats: kept for some time, and computed once for all that ask at the same time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .storage import cut


class CachedReads:
    """Results by name, written to the shared folder, for ttl_s seconds each. Callers that come while one is computed wait for it."""

    def __init__(self, ttl_s: float, clock: Callable[[], float] = time.monotonic):
        self.ttl_s, self.clock = ttl_s, clock
        self.kept: dict[str, tuple[float, DataFrame]] = {}
        self.locks: dict[str, threading.Lock] = {}
        self.guard = threading.Lock()

    def read(self, name: str, query: Callable[[], DataFrame]) -> DataFrame:
        with self.guard:
            lock = self.locks.setdefault(name, threading.Lock())
        with lock:
            found = self.kept.get(name)
            if found is None or found[0] <= self.clock():
                found = self.kept[name] = (self.clock() + self.ttl_s, cut(query()))
            return found[1]

    def forget(self, name: str) -> None:
        self.kept.pop(name, None)
