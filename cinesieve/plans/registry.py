"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from cinesieve.plans import frame_queries, report_queries, timeline_queries

FLAGSHIP = "q20_funnel"
_MODULES = (frame_queries, timeline_queries, report_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
