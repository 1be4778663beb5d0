"""Operators of a training-data pipeline over document tables.

Nothing else in the library imports this package.  Every operator takes and returns
DataFrames; ``queries.QUERIES`` holds the thin ``opN_*`` queries built on them.
"""
