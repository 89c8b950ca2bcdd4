"""All registered queries with their comparison SQL."""

from evalweave.queries import accuracy, roundtrips, texts, workload  # noqa: F401
from evalweave.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
