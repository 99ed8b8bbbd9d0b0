"""Every registered query with its SQL twin, gathered from the plan modules."""

from __future__ import annotations

from . import analyst, engine, files, lifecycle, masks, operations, parsers, security, streams, vectors  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
