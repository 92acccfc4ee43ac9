"""Weft: shape-driven knowledge analytics on Spark."""
