"""All queries of the engine and their SQL."""

from __future__ import annotations

from strandlog.plans import admin_queries, cluster_queries, log_queries, metric_queries

QUERIES = log_queries.QUERIES | cluster_queries.QUERIES | metric_queries.QUERIES | admin_queries.QUERIES
ORACLE_SQL = log_queries.SQL | cluster_queries.SQL | metric_queries.SQL | admin_queries.SQL
