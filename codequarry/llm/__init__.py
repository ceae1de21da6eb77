"""Operators for training-data pipelines, their queries and their SQL.

Nothing else in the library imports this subpackage.
"""
