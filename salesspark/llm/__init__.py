"""Operators of a training-data pipeline: each module is one operator, ``catalog`` registers one query for each.

Nothing outside this package imports it.
"""
