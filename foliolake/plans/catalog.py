"""All registered queries."""

from __future__ import annotations

from foliolake.plans import edits, flagship, governance, inventory, joins, packages, registry, rewrites, sources

PLANS = (flagship, inventory, joins, edits, governance, sources, packages, rewrites)
QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
