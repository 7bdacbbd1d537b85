"""Panels derived from the raw tables."""
