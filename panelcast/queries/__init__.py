"""Queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from . import alignment, comparisons, features, forecasts, fusions, models, panels, scores, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alignment", "comparisons", "features", "forecasts", "fusions", "models", "panels", "scores", "streams"]
