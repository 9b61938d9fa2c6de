"""Operators of a training-data pipeline.

``queries.QUERIES`` and ``queries.ORACLE_SQL`` register one query for each of them.
"""
