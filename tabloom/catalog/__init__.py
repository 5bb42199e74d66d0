"""Every operator as a query over the given tables, with SQL twins where SQL can say it."""

from tabloom.catalog import ensembles, exact, features, kits, learned, numbers, scoring, searches  # noqa: F401
from tabloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
