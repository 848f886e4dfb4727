"""All registered queries with their oracles."""

from . import catalog_queries, feature_queries, flow_queries, series_queries  # noqa: F401  (register on import)
from .roles import QUERIES, oracles
from .series_queries import flagship

__all__ = ["QUERIES", "oracles", "flagship"]
