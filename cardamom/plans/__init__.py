"""Registered queries over the driver's tables, with the SQL that each must equal."""

from . import audit, extensions, joins, merge, metrics, provider, sampling, scalars, sources, validation
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit", "extensions", "joins", "merge", "metrics", "provider", "sampling", "scalars", "sources", "validation"]
