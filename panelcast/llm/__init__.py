"""Operators for preparing training text: one module per operator, their queries in ``queries``.

Every operator takes DataFrames and returns a DataFrame. Nothing outside this folder imports it.
"""
