"""Registered queries and their SQL."""

from __future__ import annotations


def own_queries() -> tuple[dict, dict]:
    """Queries and SQL of the library's own operators; importing the modules registers them."""
    from talkmill.plans import capture_queries, discovery_queries, memory_queries, queries, registry, source_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
