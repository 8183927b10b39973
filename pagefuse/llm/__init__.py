"""Operators for preparing training text: one module for each operator.

Nothing outside this folder imports it.  ``queries.py`` holds the registered
queries and ``oracles.py`` their SQL.
"""
