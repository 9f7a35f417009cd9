"""Operators on fields, graphs, rasters and tracks."""
