"""Named queries over the driver tables, each with the SQL that checks it in DuckDB where SQL can say it."""

from __future__ import annotations

from hotelspark.workload import aggregates, cleaning, conversations, lifecycle, predicates, reports, sources
from hotelspark.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "cleaning", "conversations", "lifecycle", "predicates", "reports", "sources"]
