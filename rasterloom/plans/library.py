"""Imports the modules that register queries."""

from rasterloom.plans import decision_queries, geometry_queries, listing_queries, pixel_queries, request_queries, search_queries  # noqa: F401
from rasterloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
