"""Operators for large training-data corpora. Nothing else in the library imports this package."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
