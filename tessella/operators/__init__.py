"""Operators over points, grids, sequences, geometry, graphs and clusters."""
