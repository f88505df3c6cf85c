"""All bound queries and their SQL, from the modules that bind them."""

from __future__ import annotations

from tallyline.plans import bindings, bindings_functions, bindings_match, bindings_registry, bindings_rules, bindings_setup, bindings_views  # noqa: F401  (each registers its own)

QUERIES, ORACLE_SQL = bindings.QUERIES, bindings.ORACLE_SQL
