"""Queries and their SQL, by kind; importing this registers them all."""

from . import aggregate_queries, batch_queries, document_queries, join_queries, order_queries, text_queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregate_queries", "batch_queries", "document_queries", "join_queries", "order_queries", "text_queries"]
