"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; `queries` holds the registered `opN_` queries.
"""
