"""Helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as text and arrays of texts or numbers as joined text, so that both engines' results compare."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            out.append(F.col(name).cast("string").alias(name))
        elif kind.startswith("array<"):
            out.append(F.array_join(F.col(name).cast("array<string>"), ",").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
