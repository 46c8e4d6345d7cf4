"""Registered queries over the driver tables (``catalog`` imports them all),
their DuckDB oracle SQL (``sqltext`` renders the shared patterns for RE2),
and ``runs.research_tables``, a whole research run composed from the operators."""
