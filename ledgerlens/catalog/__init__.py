"""Importing this package registers every query."""

from ledgerlens.catalog.registry import EXPECTED_SQL, QUERIES
from ledgerlens.catalog import (  # noqa: F401
    frame_queries,
    mining_queries,
    ranking_queries,
    relational_queries,
    source_queries,
    template_queries,
    text_queries,
    view_queries,
)

__all__ = ["EXPECTED_SQL", "QUERIES"]
