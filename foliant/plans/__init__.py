"""Named queries and their SQL."""

from foliant.plans import catalog, documents, joins, pages  # noqa: F401 - each registers its queries

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL
