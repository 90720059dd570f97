"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import archive, conversations, edits, graphs, indexes, kept, lifecycle, search, stored, upkeep

_MODULES = (search, archive, conversations, lifecycle, graphs, indexes, upkeep, kept, stored, edits)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
