"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this package.  ``queries`` holds the queries
that apply each operator to its whole table, and their SQL.
"""
