"""Trial to participant to condition summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.nulls import mean_strict
from ..functions.sql import add, aggregates, quoted
from .attach import TRIAL


def cell_mean(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates({name: mean_strict(value)}))


def two_level_mean(
    df: DataFrame, by: Sequence[str], value: str, name: str, unit: Sequence[str] = TRIAL
) -> DataFrame:
    """Mean per trial, then unweighted mean of the trials in each cell of ``by``."""
    inner = list(dict.fromkeys([*by, *unit]))
    return cell_mean(cell_mean(df, inner, value, name), by, name, name)


def share_within(df: DataFrame, panel: Sequence[str], category: str) -> DataFrame:
    """Count of each category and its share of the panel total."""
    counts = df.groupBy(*panel, category).agg(*aggregates({"n": "count(1)"}))
    return add(counts, {"share": f"n / sum(n) OVER (PARTITION BY {', '.join(panel)})"})


def sum_at_first(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of a group that hold its least ``order``, all ties included.

    Rows are first added up by ``order``, map-side too, so ties of any number are one row
    before the least is taken. A missing value among the ties makes the sum missing; rows
    without ``order`` do not count.
    """
    total = f"CASE WHEN count({value}) = count(1) THEN sum({value}) END"
    ties = df.where(f"{quoted(order)} IS NOT NULL").groupBy(*map(quoted, by), quoted(order)).agg(*aggregates({"_sum": total}))
    return ties.groupBy(*map(quoted, by)).agg(*aggregates({name: f"min_by(_sum, {quoted(order)})"}))
