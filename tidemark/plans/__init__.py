"""All registered queries of the library."""

from __future__ import annotations

from tidemark.plans import aggregate_queries, audit_queries, detection_queries, interval_queries, join_queries, record_queries, sequence_queries, source_queries, stream_queries, text_queries, timeline_queries  # noqa: F401  they register themselves
from tidemark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
