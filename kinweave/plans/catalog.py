"""All registered queries."""

from . import correction_queries, job_queries, pair_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
