"""Geometry operators on streams."""
