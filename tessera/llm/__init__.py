"""Operators that prepare training data: deduplication, scoring, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
