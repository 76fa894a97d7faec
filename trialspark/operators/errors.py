"""Standard errors and confidence intervals for repeated measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.sql import add, aggregates, quoted
from ..functions.student_t import t975, t_quantile


def error_cells(df: DataFrame, by: Sequence[str], measures: Mapping[str, str], subject: str = "participant") -> DataFrame:
    """State of :func:`within_error`: one row per subject and condition.

    Columns ``by``, ``subject``, ``_n`` (rows) and, for the i-th measure, ``_mean<i>`` and
    ``_dev<i>`` (sum of squared deviations), NULL if a value is missing. States of several
    days are put together by :func:`merge_cells`.
    """
    by, own_key = [quoted(c) for c in by], quoted(subject)
    # inside, measures are numbered; their names appear at the end only
    values = df.selectExpr(*by, own_key, *[f"CAST({sql} AS DOUBLE) AS _v{i}" for i, sql in enumerate(measures.values())])
    parts = {"_n": "count(1)"}
    for i in range(len(measures)):
        parts[f"_mean{i}"] = f"CASE WHEN count(_v{i}) = count(1) THEN avg(_v{i}) END"
        parts[f"_dev{i}"] = f"CASE WHEN count(_v{i}) = count(1) THEN var_pop(_v{i}) * count(1) END"
    return values.groupBy(*by, own_key).agg(*aggregates(parts))


def merge_cells(states: Sequence[DataFrame], by: Sequence[str], subject: str = "participant") -> DataFrame:
    """The state of all rows from the states of parts of them, whatever the number of parts.

    Deviations are taken about the mean of the first part that has the cell: sums of squares
    about a near point keep their digits, and one pass does.
    """
    every = [quoted(c) for c in (*by, subject)]
    numbers = range(sum(c.startswith("_mean") for c in states[0].columns))
    stacked = reduce(DataFrame.unionByName, states)
    near = {f"_near{i}": f"min(_mean{i}) OVER (PARTITION BY {', '.join(every)})" for i in numbers}
    shifted = add(stacked, near)
    out = {"_total": "sum(_n)"}
    for i in numbers:
        step = f"(_mean{i} - _near{i})"
        known = f"count(_mean{i}) = count(1)"
        out[f"_m{i}"] = f"CASE WHEN {known} THEN min(_near{i}) + sum(_n * {step}) / sum(_n) END"
        out[f"_d{i}"] = f"CASE WHEN {known} THEN sum(_dev{i}) + greatest(sum(_n * {step} * {step}) - power(sum(_n * {step}), 2) / sum(_n), 0D) END"
    merged = shifted.groupBy(*every).agg(*aggregates(out))
    return merged.selectExpr(*every, "_total AS _n", *[f"_{short}{i} AS _{long}{i}" for i in numbers for short, long in (("m", "mean"), ("d", "dev"))])


def error_of_cells(
    cells: DataFrame, by: Sequence[str], names: Sequence[str], subject: str = "participant", level: float = 0.95
) -> DataFrame:
    """The summary of :func:`within_error` from its state; ``names`` as the measures were."""
    by, own = [quoted(c) for c in by], f"OVER (PARTITION BY {quoted(subject)})"
    centred = {
        f"_c{i}": f"_mean{i} - CASE WHEN count(_mean{i}) {own} = count(1) {own} "
        f"THEN sum(_n * _mean{i}) {own} / sum(_n) {own} END"
        for i in range(len(names))
    }
    cells = add(cells, centred)

    out = {"n": "sum(_n)"}
    for i in range(len(names)):
        out[f"_m{i}"] = f"CASE WHEN count(_mean{i}) = count(1) THEN sum(_n * _mean{i}) / sum(_n) END"
        squares = f"sum(_dev{i} + _n * _c{i} * _c{i}) - power(sum(_n * _c{i}), 2) / sum(_n)"
        out[f"_ss{i}"] = f"CASE WHEN count(_c{i}) = count(1) THEN greatest({squares}, 0D) END"
    summary = cells.groupBy(*by).agg(*aggregates(out))

    quantile = t975("(n - 1)") if level == 0.95 else t_quantile((1 + level) / 2, "(n - 1)")
    final = []
    for i, k in enumerate(names):
        # sd / sqrt(n - 1) with sd = sqrt(ss / (n - 1))
        se = f"try_divide(sqrt(_ss{i}), n - 1)"
        out_names = [quoted(f"{s}_{k}") for s in ("m", "se", "ci")]
        final += [f"_m{i} AS {out_names[0]}", f"{se} AS {out_names[1]}", f"{se} * ({quantile}) AS {out_names[2]}"]
    return summary.selectExpr(*by, "n", *final)


def within_error(
    df: DataFrame, by: Sequence[str], measures: Mapping[str, str], subject: str = "participant", level: float = 0.95
) -> DataFrame:
    """Mean, within-subject standard error and interval per condition.

    ``measures`` maps output names to value expressions. Values are centred on the
    mean of their subject over the whole frame; then per condition m = mean of the
    raw values, se = sd(centred) / sqrt(n - 1) and ci = se * t of ``level`` at n - 1,
    where n counts rows, not subjects. A missing value makes its condition's mean, and
    every figure that depends on its subject's mean, missing.

    All measures share one pass. Rows are first reduced to (subject, condition)
    cells of count, mean and sum of squared deviations, combined map-side; subject
    means and centred variances follow exactly from the cells. No window sees raw
    rows, so a subject with most of the data is no bottleneck.
    """
    return error_of_cells(error_cells(df, by, measures, subject), by, list(measures), subject, level)


def between_error(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean and sd / sqrt(n - 1) of the raw values; NULL for a single row."""
    known = f"count({value}) = count(1)"
    return df.groupBy(*map(quoted, by)).agg(
        *aggregates(
            {
                "n": "count(1)",
                f"m_{name}": f"CASE WHEN {known} THEN avg({value}) END",
                f"se_{name}": f"CASE WHEN {known} THEN try_divide(stddev_samp({value}), sqrt(count(1) - 1)) END",
            }
        )
    )
