"""Imports every module that registers queries."""

from . import q_analytics, q_detect, q_enrich, q_live, q_ops, q_stream, q_whole
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "q_analytics", "q_detect", "q_enrich", "q_live", "q_ops", "q_stream", "q_whole"]
