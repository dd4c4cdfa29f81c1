"""Operators for large training-data pipelines: filtering, deduplication, tokenization and packing.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` registers
the thin query of each.
"""
