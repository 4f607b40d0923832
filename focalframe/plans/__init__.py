"""Registered queries and their oracle SQL."""

from . import catalog_queries, dense_queries, metadata_queries, project_queries, raster_queries, selection_queries, store_queries, warp_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "dense_queries", "metadata_queries", "project_queries", "raster_queries", "selection_queries", "store_queries", "warp_queries"]
