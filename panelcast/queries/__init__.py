"""Registered queries, one module per operator family."""

from panelcast.queries import (  # noqa: F401  (importing registers)
    q_forecast,
    q_joins,
    q_profile,
    q_runs,
    q_text,
    q_transfer,
    q_windows,
)
from panelcast.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
