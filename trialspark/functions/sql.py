"""Literals and small DataFrame helpers around SQL expression text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Iterable) -> str:
    return ", ".join(literal(v) for v in values)


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def add(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Append computed columns; one may use those listed before it."""
    return df.selectExpr("*", *[f"{sql} AS {quoted(name)}" for name, sql in columns.items()])


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(f"* EXCEPT ({', '.join(map(quoted, names))})")


def aggregates(columns: Mapping[str, str]) -> list[Column]:
    return [F.expr(f"{sql} AS {quoted(name)}") for name, sql in columns.items()]


def compute_once(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Append computed columns whose expressions later filters do not copy.

    The optimizer moves a filter below a projection by pasting the projected
    expressions into it. For nested conditions over derived columns the pasted
    condition multiplies until the generated code no longer compiles. The output
    of a one-row generator is a fresh attribute, so a filter on it stays where it
    is; filters on the other columns still move to the scan. A column may use an
    earlier one under the name ``_once_<name>``.
    """
    staged = add(df, {f"_once_{n}": sql for n, sql in columns.items()})
    fields = ", ".join(f"{literal(n)}, {quoted('_once_' + n)}" for n in columns)
    hidden = ", ".join(quoted("_once_" + n) for n in columns)
    return staged.selectExpr(f"* EXCEPT ({hidden})", f"inline(array(named_struct({fields})))")
