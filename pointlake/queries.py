"""All queries of the particle engine and their SQL."""

from pointlake import catalog, catalog_files, catalog_values  # noqa: F401  (they register)
from pointlake.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
