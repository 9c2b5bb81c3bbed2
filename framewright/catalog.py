"""All queries of the engine itself, by name, and the same in SQL."""

from framewright.plans import queries

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
