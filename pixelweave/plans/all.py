"""Imports every query module, so that the registry is full."""

from __future__ import annotations

from pixelweave.plans import aggregates, filters_joins, projections, rasters, refined, sources_sinks, streams, structures, whole_rows, windows_scalars
from pixelweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "filters_joins", "projections", "rasters", "refined", "sources_sinks", "streams", "structures", "whole_rows", "windows_scalars"]
