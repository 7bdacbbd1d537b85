"""Incremental daily bars from an event stream."""
