"""Visits of any number of items: which were seen, in which order, and whether again.

The two-target markers have a closed form for two first and last visits. Here each item of
a display has a first and a last visit of its own; sorted by the first visit, an item was
seen again exactly if its last visit comes after the first visit of the next one. The
state of a trial is a fixed number of numbers for each item, so this is one hash
aggregation with map-side partial results, as for the markers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.geometry import AOI_RADIUS, item_distance
from ..functions.sql import add, aggregates, compute_once, drop, literal
from .attach import TRIAL
from .markers import TRIAL_ATTRIBUTES, attribute_states, attribute_values, known_keys

#: labels of ``visit_pattern``
VISIT_PATTERNS = ("No fix.", "Single fix.", "Some fix.", "All fix.", "Refixation")


def see_items(events: DataFrame, items: Mapping[str, str], rival: str | None = None) -> DataFrame:
    """Add ``item_seen``: 1-based number of the nearest item whose area holds the gaze, else NULL.

    ``items`` are names and position columns. A position of NULL or 0 is an item that is
    not there. Of items at the same distance the later one counts. With ``rival``, another
    position column, an item only counts if the rival is not strictly nearer.
    """
    gaze = ("average_gaze_x", "average_gaze_y")
    distances = {f"_d{i}": item_distance(pos, *gaze) for i, pos in enumerate(items.values(), 1)}
    if rival:
        distances["_rival"] = item_distance(rival, *gaze)
    near = f"array_min(array({', '.join(f'_d{i}' for i in range(1, len(items) + 1))}))"
    nearest = " ".join(f"WHEN _d{i} THEN {i}" for i in range(len(items), 0, -1))
    inside = f"_near < {literal(AOI_RADIUS)}" + " AND _near <= coalesce(_rival, _near)" * bool(rival)
    measured = compute_once(add(events, distances), {"_near": near})
    return drop(add(measured, {"item_seen": f"CASE WHEN {inside} THEN CASE _near {nearest} END END"}), *distances, "_near")


def trial_visits(
    events: DataFrame,
    items: Mapping[str, str],
    attributes: Mapping[str, Sequence[str] | None] = TRIAL_ATTRIBUTES,
    during: str = "cat = 'Search'",
) -> DataFrame:
    """One row per trial from events with ``item_seen``, in one shuffle of partial results.

    * ``n_items``, ``n_seen``: items that are there, and those visited
    * ``visit_pattern``: no item, a single one, some or all of them; Refixation if an item was
      seen again after another one was first seen after it
    * ``seen_order``: names in order of their first visits
    * ``first_item``, ``first_item_at``, ``first_item_time``: the first visit of any item
    * ``all_seen_at``, ``all_seen_time``: the visit that completed them, if all were seen

    Positions and ``attributes`` must be constant within a trial and event keys known; anything
    else raises. ``fix_count`` must be unique within a trial (see ``trial_markers``).
    """
    constant = {**{pos: None for pos in items.values()}, **attributes}
    coded, states = attribute_states(known_keys(events), constant)
    for i in range(1, len(items) + 1):
        visit = f"CASE WHEN {during} AND item_seen = {i} THEN fix_count END"
        states |= {f"_first{i}": f"min({visit})", f"_last{i}": f"max({visit})", f"_time{i}": f"min_by(start_time, {visit})"}
    grouped = attribute_values(coded.groupBy(*TRIAL).agg(*aggregates(states | {"_events": "count(1)"})), constant)

    visits = ", ".join(
        f"named_struct('at', _first{i}, 'last', _last{i}, 'time', _time{i}, 'name', {literal(name)})" for i, name in enumerate(items, 1)
    )
    there = " + ".join(f"CAST(coalesce({pos}, 0) <> 0 AS INT)" for pos in items.values())
    listed = compute_once(
        grouped,
        {"_seen": f"array_sort(filter(array({visits}), v -> v.at IS NOT NULL))", "n_items": there},
    )
    again = "exists(transform(_seen, (v, i) -> coalesce(v.last > get(_seen, i + 1).at, false)), x -> x)"
    derived = add(
        listed,
        {
            "n_seen": "size(_seen)",
            "visit_pattern": f"""CASE WHEN n_seen = 0 THEN 'No fix.' WHEN n_seen = 1 THEN 'Single fix.'
                WHEN {again} THEN 'Refixation' WHEN n_seen = n_items THEN 'All fix.' ELSE 'Some fix.' END""",
            "seen_order": "array_join(transform(_seen, v -> v.name), ' > ')",
            "first_item": "get(_seen, 0).name",
            "first_item_at": "get(_seen, 0).at",
            "first_item_time": "get(_seen, 0).time",
            "all_seen_at": "CASE WHEN n_seen = n_items THEN get(_seen, n_seen - 1).at END",
            "all_seen_time": "CASE WHEN n_seen = n_items THEN get(_seen, n_seen - 1).time END",
        },
    )
    return drop(derived, "_seen", *(f"_{part}{i}" for i in range(1, len(items) + 1) for part in ("first", "last", "time")))
