"""Registered queries and their DuckDB SQL."""

from . import replies as _replies  # noqa: F401  registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
