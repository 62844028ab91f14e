"""Handlers: user functions by kind of job, run over claimed jobs in batches, whose results go back as rows."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

RESULTS = "id long, run_lease long, result string, delay_s double, error string, progress int, metadata string"


@dataclasses.dataclass
class Result:
    """What a handler gives back: completed, cancel, wait, terminal, retryable, retry_after or snooze."""

    kind: str = "completed"
    delay_s: float = 0.0
    error: str | None = None


def retry_after(seconds: float) -> Result:
    return Result("retry_after", seconds)


def snooze(seconds: float) -> Result:
    return Result("snooze", seconds)


def cancel(reason: str | None = None) -> Result:
    return Result("cancel", 0.0, reason)


class Terminal(Exception):
    """An error after which a job isn't tried again."""


@dataclasses.dataclass
class Context:
    """What a handler sees of its job and may leave: progress (0 to 100) and metadata."""

    id: int
    kind: str
    attempt: int
    cancelled: bool = False
    state: dict = dataclasses.field(default_factory=dict)
    progress: int | None = None
    metadata: dict = dataclasses.field(default_factory=dict)

    def set_progress(self, percent: int) -> None:
        self.progress = min(max(int(percent), 0), 100)

    def note(self, **members) -> None:
        self.metadata |= members

    def extract(self, kind: type):
        return self.state[kind.__name__]


class Registry:
    """Handlers by kind, and the schedules that go with them."""

    def __init__(self):
        self.handlers: dict[str, tuple[Callable, type | None]] = {}
        self.schedules: list[tuple[str, str, str, str]] = []
        self.state: dict = {}

    def task(self, kind: str, args: type | None = None):
        """Decorates a handler (args, context) of jobs of a kind; args is a dataclass into which a job's arguments are read."""

        def keep(f):
            if kind in self.handlers:
                raise ValueError(f"{kind} has a handler")
            self.handlers[kind] = (f, args)
            return f

        return keep

    def periodic(self, name: str, expression: str, kind: str, timezone: str = "UTC") -> None:
        from ..functions.cron import Cron

        Cron.parse(expression, timezone)
        self.schedules.append((name, expression, timezone, kind))

    def run(self, job) -> tuple:
        context = Context(int(job.id), job.kind, int(job.attempt), bool(getattr(job, "cancelled", False)), self.state)
        try:
            handler, kind = self.handlers[job.kind]
            raw = json.loads(job.args or "{}")
            out = handler(kind(**raw) if kind else raw, context)
            result = out if isinstance(out, Result) else Result()
        except KeyError as e:
            result = Result("terminal", 0.0, f"no handler or member {e}")
        except Terminal as e:
            result = Result("terminal", 0.0, str(e))
        except Exception as e:  # a handler's error is its job's result
            result = Result("retryable", 0.0, str(e))
        return int(job.id), int(job.run_lease), result.kind, float(result.delay_s), result.error, context.progress, json.dumps(context.metadata, sort_keys=True) if context.metadata else None


def perform(claimed: DataFrame, registry: Registry) -> DataFrame:
    """The results of claimed jobs (id, kind, args, attempt, run_lease), one row each, for transitions.outcomes. Handlers run in the
    executors, a batch of jobs at a time."""
    import pandas as pd

    names = [x.split()[0] for x in RESULTS.split(", ")]

    def run(frames: Iterator):
        for f in frames:
            yield pd.DataFrame([registry.run(r) for r in f.itertuples(index=False)], columns=names).astype({"progress": "Int32"})

    return claimed.select(*[c for c in ("id", "kind", "args", "attempt", "run_lease", "cancelled") if c in claimed.columns]).mapInPandas(run, RESULTS)
