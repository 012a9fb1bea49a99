"""Registered queries and the SQL they are checked against."""

from sluice.plans import composition, graphs, listings, logs, sequences, texts  # noqa: F401
from sluice.plans.oracle import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
