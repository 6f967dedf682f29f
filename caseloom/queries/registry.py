"""All core queries by name."""

from __future__ import annotations

from caseloom.queries import projection, reports, schema_growth, scoring, sessions, similar, texts, timestamps

MODULES = (projection, reports, schema_growth, scoring, sessions, similar, texts, timestamps)
FLAGSHIP = "current_projection"
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
