"""All registered layout queries and their SQL."""

from __future__ import annotations

from pagequarry.plans import choices, queries, report

QUERIES = queries.QUERIES | report.QUERIES | choices.QUERIES
SQL = queries.SQL | report.SQL | choices.SQL
