"""Every operator on the derived catalog, each with the SQL that must give the same rows."""

from checks import graph, metrics, sources, state, textjobs, views  # noqa: F401
from checks.base import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
