"""Registered queries with their equivalent SQL."""

from logquarry.catalog import aggregates, files, knowledge, parsing, scalars, selection, streams
from logquarry.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "files", "knowledge", "parsing",
           "scalars", "selection", "streams"]
