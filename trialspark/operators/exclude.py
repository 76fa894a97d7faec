"""Keep or drop whole participants by the completeness of their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.nulls import any_true
from ..functions.sql import add, aggregates, drop


def participants_with(df: DataFrame, cells: Sequence[str], subject: str = "participant") -> DataFrame:
    """Subjects that have at least one row in every listed cell (conditions).

    One aggregation in place of an intersection of per-cell subject sets.
    """
    found = df.groupBy(subject).agg(*aggregates({f"_has_{i}": any_true(c) for i, c in enumerate(cells)}))
    return found.where(" AND ".join(f"_has_{i}" for i in range(len(cells)))).select(subject)


def participants_missing(df: DataFrame, columns: Sequence[str], subject: str = "participant") -> DataFrame:
    """Subjects with a NULL in any of the columns on any row."""
    gap = " OR ".join(f"{c} IS NULL" for c in columns)
    return df.where(gap).select(subject).distinct()


def keep_participants(df: DataFrame, listed: DataFrame, subject: str = "participant") -> DataFrame:
    return df.join(listed, subject, "left_semi")


def drop_participants(df: DataFrame, listed: DataFrame, subject: str = "participant") -> DataFrame:
    return df.join(listed, subject, "left_anti")


# The rules below are for frames already reduced to a few cells per subject: the
# subject's cells decide about themselves in a window, so the frame is not
# computed a second time to list the subjects.


def _where_over(df: DataFrame, condition: str) -> DataFrame:
    return drop(add(df, {"_keep": condition}).where("_keep"), "_keep")


def keep_with_cells(cells: DataFrame, required: Sequence[str], subject: str = "participant") -> DataFrame:
    """Rows of subjects that have a row for every required condition."""
    has = [f"coalesce(bool_or({c}) OVER (PARTITION BY {subject}), false)" for c in required]
    return _where_over(cells, " AND ".join(has))


def keep_with_count(cells: DataFrame, rows: int, subject: str = "participant") -> DataFrame:
    """Rows of subjects with exactly ``rows`` rows."""
    return _where_over(cells, f"count(1) OVER (PARTITION BY {subject}) = {rows}")


def drop_with_missing(cells: DataFrame, columns: Sequence[str], subject: str = "participant") -> DataFrame:
    """Rows of subjects that have no NULL in the columns on any row."""
    gap = " OR ".join(f"{c} IS NULL" for c in columns)
    return _where_over(cells, f"NOT bool_or({gap}) OVER (PARTITION BY {subject})")
