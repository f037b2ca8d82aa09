"""Registered queries and the SQL that they are checked against."""

from tripspark.plans import changes, curated, more, networks  # noqa: F401  register further queries
from tripspark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
