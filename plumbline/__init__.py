"""Geometry columns on Spark, and operators that go with them."""

__version__ = "0.1.0"
