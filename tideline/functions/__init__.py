"""Helpers on columns and small tables."""
