"""Ordered categories as a label plus a small integer rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from .sql import literal, literals


def recode(col: str, labels: Mapping[str, str]) -> str:
    """Translate levels to labels; a level that is not listed becomes NULL."""
    cases = " ".join(f"WHEN {literal(level)} THEN {literal(label)}" for level, label in labels.items())
    return f"CASE {col} {cases} END"


def rank_of(col: str, levels: Sequence[str]) -> str:
    """1-based rank of a label within its levels, NULL when not listed."""
    return f"CAST(nullif(array_position(array({literals(levels)}), {col}), 0) AS INT)"


def label_at(rank: str, levels: Sequence[str]) -> str:
    """Inverse of :func:`rank_of`."""
    return f"get(array({literals(levels)}), {rank} - 1)"
