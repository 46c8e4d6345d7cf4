"""All registered queries (importing the plan modules fills the registry)."""

from __future__ import annotations

from citeline.plans import conversations, documents, events, pages, research, responses, streams, trees, web  # noqa: F401
from citeline.plans import reporting  # noqa: F401  (uses the SQL registered above)
from citeline.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
