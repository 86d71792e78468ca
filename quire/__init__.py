"""Structuring of long documents on Spark."""
