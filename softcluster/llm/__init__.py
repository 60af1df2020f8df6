"""Operators of a training-data pipeline (dedup, filters, formatting, packing).

Each operator is a module with a general interface over DataFrames;
``queries`` applies them to the registered tables.
"""
