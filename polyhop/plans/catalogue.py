"""All graph queries and their SQL."""

from . import io_queries, lane_queries, model_queries  # noqa: F401
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
