"""Scans, byte rasters, generated rasters and header readers."""
