"""Last event strictly before per-trial points in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.sql import add, drop
from .attach import TRIAL, attach


def last_before(
    events: DataFrame,
    per_trial: DataFrame,
    event_time: str,
    points: Mapping[str, tuple[str, str]],
    weight: str,
    carry: Sequence[str] = (),
    on: Sequence[str] = TRIAL,
    **split,
) -> DataFrame:
    """Rows of ``events`` at the latest time before each of the trial's points, ties kept.

    ``points`` maps a type to two ``per_trial`` columns, the marker and its time;
    the result has one set of rows per type with the columns ``type``, ``marker``
    and ``marker_time`` added. A trial that lacks a point has no row for it.
    ``carry`` names further ``per_trial`` columns to add.

    All points and all rows take one pass and one shuffle of the events. Within
    each (trial, lane) the rows are already together, so the latest time there is
    found first; only its rows go on to the comparison across the lanes of a
    trial. Lanes bound both steps for a trial of any size. ``weight`` as in
    ``attach``.
    """
    on = list(on)
    trial = ", ".join(on)
    marks = [*[c for pair in points.values() for c in pair], *carry]
    any_point = " OR ".join(f"{time} IS NOT NULL" for _, time in points.values())
    sized = per_trial.where(any_point).select(*on, *marks, weight)
    own = [c for c in events.columns if c not in on]
    rows = attach(events, sized, weight, on, keep_lane=True, **split)

    def before(time: str) -> str:
        return f"CASE WHEN {event_time} < {time} THEN {event_time} END"

    latest = {
        f"_last{i}": f"max({before(time)}) OVER (PARTITION BY {trial}, _lane)"
        for i, (_, time) in enumerate(points.values())
    }
    at_latest = " OR ".join(f"{event_time} = _last{i}" for i in range(len(points)))
    local = add(rows, latest).where(at_latest)
    kinds = ", ".join(
        f"named_struct('type', '{kind}', 'marker', {marker}, 'marker_time', {time}, '_last', _last{i})"
        for i, (kind, (marker, time)) in enumerate(points.items())
    )
    typed = local.selectExpr(*on, *own, *carry, f"inline(array({kinds}))").where(f"{event_time} = _last")
    final = add(typed, {"_best": f"max(_last) OVER (PARTITION BY {trial}, type)"}).where("_last = _best")
    return drop(final, "_last", "_best")
