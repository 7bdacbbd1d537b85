"""Factors as window and row expressions, and statistics over cross-sections."""
