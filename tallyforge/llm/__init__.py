"""Operators for a training-data pipeline over very large text tables.

Nothing outside this subpackage imports it. `catalog` lists its queries and
their SQL.
"""
