"""Explicit schemas of the engine's tables."""

from __future__ import annotations

PROBABILITY = "session string, class_name string, r int, c int, v double"
GEOTRANSFORM = "raster_id string, a double, b double, c double, d double, e double, f double, crs string, width long, height long"
ORTHO_CSV = "root_folder string, ortho_name string"
SESSION_CSV = "root_folder string, session_name string"
GPS = "GPSLongitude double, GPSLatitude double"
LABEL_TILE = "ortho_id string, tile_x long, tile_y long, r int, c int, cls short"
