"""Importing this module registers every query of the core."""

from . import relational_queries, scalar_queries, search_queries, snapshot_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
