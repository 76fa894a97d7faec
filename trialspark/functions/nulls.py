"""Conditions and aggregates that treat NULL as "unknown" all the way through.

Spark's ``CASE WHEN c THEN a ELSE b`` sends an unknown condition to ``b`` and its
``avg`` skips NULLs; statistical scripts expect an unknown to stay unknown.
"""

from __future__ import annotations

from collections.abc import Iterable

from .sql import literals


def ifelse3(cond: str, yes: str, no: str) -> str:
    """``yes`` / ``no`` / NULL for a true / false / unknown condition."""
    return f"(CASE WHEN {cond} THEN {yes} WHEN NOT ({cond}) THEN {no} END)"


def isin_safe(col: str, values: Iterable) -> str:
    """Set membership that is false, never NULL, for a NULL input."""
    return f"coalesce({col} IN ({literals(values)}), false)"


def any_true(cond: str) -> str:
    """Aggregate: does the condition hold on some row (false if none is known)."""
    return f"coalesce(bool_or({cond}), false)"


def mean_strict(value: str) -> str:
    """Aggregate: mean, NULL as soon as one value is NULL."""
    return f"CASE WHEN count({value}) = count(1) THEN avg({value}) END"
