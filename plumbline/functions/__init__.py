"""Expressions over geometry columns."""
