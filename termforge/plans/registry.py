"""All queries of the engine by name, and the SQL that gives the same rows."""

from termforge.plans import contrast_queries, stats_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (text_queries, contrast_queries, stats_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
