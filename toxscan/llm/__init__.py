"""Operators of a training-data pipeline: formatting, de-duplication, extraction, filtering, packing.

Nothing outside this subpackage imports it. ``queries.py`` lists its queries and their SQL.
"""
