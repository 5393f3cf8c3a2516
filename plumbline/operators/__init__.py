"""Operators by name."""
