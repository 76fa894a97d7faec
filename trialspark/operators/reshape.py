"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.sql import aggregates, literal


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], value: str) -> DataFrame:
    """One column per listed value, for rows that are unique on ``ids`` and ``name``.

    Conditional aggregates: one shuffle, with the rows of a group merged before
    it, where a pivot would group twice.
    """
    picked = {v: f"max(CASE WHEN {name} = {literal(v)} THEN {value} END)" for v in values}
    return df.groupBy(*ids).agg(*aggregates(picked))


def spread_statistics(
    df: DataFrame, ids: Sequence[str], statistics: Sequence[str], measures: Sequence[str], name: str
) -> DataFrame:
    """Columns ``<statistic>_<measure>`` to one row per measure, one column per statistic."""
    long = to_long(df, ids, [f"{s}_{m}" for s in statistics for m in measures], "_column", "_value")
    split = f"split(_column, {literal('_')}, 2)"
    named = long.selectExpr(*ids, f"get({split}, 0) AS _stat", f"get({split}, 1) AS {name}", "_value")
    return to_wide(named, [*ids, name], "_stat", statistics, "_value")
