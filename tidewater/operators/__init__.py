"""Operators on event tables."""
