"""Named queries over the driver tables, and their SQL for comparison."""

from __future__ import annotations

from edgetide.plans import queries_io, queries_log, queries_reports

_MODULES = (queries_log, queries_reports, queries_io)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
