"""Imports every module that registers queries."""

from .plans import control, more, operations, reads, rebuild, transitions  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
