"""Every named query of the engine; importing this module registers them."""

from __future__ import annotations

from storyweft.plans import cascade_queries, catalogue_queries, service_queries, stored_queries, story_queries, text_queries  # noqa: F401
from storyweft.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
