"""The registered queries with their reference SQL, by topic."""

from . import audits, checks, findings, links, retrieval, tables
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audits", "checks", "findings", "links", "retrieval", "tables"]
