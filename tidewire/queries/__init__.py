"""All named queries of the engine, with their SQL."""

from tidewire.queries import ingest, more, relational, reports, signals, streams, wider  # noqa: F401
from tidewire.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
