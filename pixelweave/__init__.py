"""Raster-style analytics and corpus preparation expressed as Spark plans."""
