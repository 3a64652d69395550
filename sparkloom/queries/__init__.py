"""All queries of the core operators and their SQL."""

from . import graphs, histories, retrievals, tables, texts, workspace
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graphs", "histories", "retrievals", "tables", "texts", "workspace"]
