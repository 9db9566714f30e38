"""The engine's own queries by name and the SQL each is held against."""

from millrace.queries import accounts, decisions, pages, texts, threads  # noqa: F401  each adds its queries
from millrace.queries.registered import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
