"""Named queries over the driver tables, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from . import deidentify, exports, findings, frames, hierarchy  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
