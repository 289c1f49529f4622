"""Queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from millrace.plans import queries as q
from millrace.plans.oracle import ORACLE_SQL

#: synthetic_evaluation trains forests: it has no SQL.
QUERIES = {name: getattr(q, name if name != "episodes" else "episodes_query") for name in [*ORACLE_SQL, "synthetic_evaluation"]}

__all__ = ["ORACLE_SQL", "QUERIES"]
