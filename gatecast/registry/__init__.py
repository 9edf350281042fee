"""All registered queries."""

from gatecast.registry import fitted, history, plans, rows, shapes, stored, values
from gatecast.registry.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "fitted", "history", "plans", "rows", "shapes", "stored", "values"]
