"""Registered queries over the given tables, each with its DuckDB twin where SQL can state it."""

from workload.base import ORACLES, QUERIES
from workload import batching, planning, results, sources, streams, timing  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
