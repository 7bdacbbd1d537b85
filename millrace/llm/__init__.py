"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; its queries are registered by
``millrace.llm.queries`` and picked up by the entry module when the subpackage
is present.
"""
