"""Columns and windows that features are made of."""
