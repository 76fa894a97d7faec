"""Frames whose columns differ: controlled fill and a report of the differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attach import row_counts


class SchemaDriftError(ValueError):
    """A frame lacks a column that may not be filled."""


def filled_columns(columns: Sequence[Sequence[str]], fill: Sequence[str]) -> list[str]:
    """All columns of some sources, and ``fill``; any other difference between the sources raises."""
    if not columns:
        raise ValueError("no frames to combine")
    everything = dict.fromkeys(c for own in columns for c in own)
    for i, own in enumerate(columns):
        if missing := sorted(set(everything) - set(own) - set(fill)):
            raise SchemaDriftError(f"frame {i} lacks columns that may not be filled: {missing}")
    return list(everything | dict.fromkeys(fill))


def union_filled(frames: Sequence[DataFrame], fill: Sequence[str]) -> DataFrame:
    """Stack frames; columns listed in ``fill`` are NULL where a frame lacks them.

    Any other difference between the frames raises.
    """
    columns = filled_columns([f.columns for f in frames], fill)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    absent = [c for c in columns if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else out


def not_shared(pairs: DataFrame, source: str, column: str) -> DataFrame:
    """Columns that do not occur in every source, from (source, column) rows.

    Distinct pairs are combined map-side; an empty input gives an empty result.
    """
    seen = pairs.select(source, column).distinct()
    per_column = row_counts(seen, [column], "n_sources")
    n_all = seen.agg(F.count_distinct(source)).scalar()
    return per_column.where(F.col("n_sources") < n_all)
