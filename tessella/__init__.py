"""Tessella: grid, point, track and graph analytics as PySpark DataFrame plans."""

__version__ = "0.1.0"
