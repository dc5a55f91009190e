"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage; ``queries`` holds the
thin registered queries and ``oracles`` their SQL.
"""
