"""Imports every query module so that the register is complete."""

from __future__ import annotations

from tapeflow.queries import context, desk, intake, learning, matrix, prices, strategy  # noqa: F401
from tapeflow.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
