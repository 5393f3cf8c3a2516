"""Geometry columns in tables and files."""
