"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface and, at its end, the thin ``opN_<name>`` query
that applies it to its table.  ``queries.py`` lists the queries and their SQL.
"""
