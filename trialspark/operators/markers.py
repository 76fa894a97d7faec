"""First occurrences and visit pattern of every trial, in one aggregation.

Each marker is a conditional min / max / min_by with a fixed-size buffer, so the
whole table is one hash aggregation with map-side partial results: no window, no
join back, and a trial of any size sends one row per map task. Columns that a
query does not use are pruned from the aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.categories import label_at, rank_of
from ..functions.sql import add, aggregates, compute_once, drop, literal, quoted
from .attach import TRIAL
from .classify import EVENT_CLASSES
from .positions import REGIONS
from .trial_log import RESPONSES

# Labels of the visit patterns.
PATTERNS = ("No fix.", "Single tar. fix.", "Both fix.", "Refixation")
#: columns that are constant within a trial, with their levels; None for numbers
TRIAL_ATTRIBUTES = {"dist_region": REGIONS, "response": RESPONSES, "response_corr": None}


def visit_pattern(first1: str, last1: str, first2: str, last2: str) -> str:
    """Pattern label from the first and last visit of each of two targets.

    Refixation: the target seen first is seen again after the other was first seen.
    """
    return f"""CASE
        WHEN {first1} IS NULL AND {first2} IS NULL THEN 'No fix.'
        WHEN {first1} IS NULL OR {first2} IS NULL THEN 'Single tar. fix.'
        WHEN {first1} < {first2} AND {last1} > {first2} THEN 'Refixation'
        WHEN {first2} < {first1} AND {last2} > {first1} THEN 'Refixation'
        ELSE 'Both fix.' END"""


def _code(column: str, levels: Sequence[str] | None) -> str:
    """A label as its rank, so that the aggregation buffer stays numeric; an unknown label raises."""
    if levels is None:
        return quoted(column)
    rank, unknown = rank_of(quoted(column), levels), literal(f"{column} has a label outside its levels")
    return f"CASE WHEN {quoted(column)} IS NOT NULL THEN coalesce({rank}, CAST(raise_error({unknown}) AS INT)) END"


def known_keys(events: DataFrame) -> DataFrame:
    """The events; one without a participant, trial number or index raises when it is read."""
    known = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in (*TRIAL, "fix_count"))
    return events.where(f"CASE WHEN {known} THEN true ELSE raise_error('an event lacks its key') END")


def attribute_states(events: DataFrame, attributes: Mapping[str, Sequence[str] | None]) -> tuple[DataFrame, dict[str, str]]:
    """Events with coded attributes, and the aggregates that tell whether one varies within a trial."""
    coded = add(events, {f"_code{i}": _code(c, levels) for i, (c, levels) in enumerate(attributes.items())})
    states = {}
    for i in range(len(attributes)):
        states |= {f"_low{i}": f"min(_code{i})", f"_high{i}": f"max(_code{i})", f"_known{i}": f"count(_code{i})"}
    return coded, states


def attribute_values(
    trials: DataFrame, attributes: Mapping[str, Sequence[str] | None], more: Mapping[str, str] | None = None
) -> DataFrame:
    """Trials with their attributes (and ``more`` columns) in place of the states and of ``_events``, the rows of a trial.

    An attribute that varies within a trial raises.
    """
    n = len(attributes)
    constant = " AND ".join(f"(_known{i} = 0 OR _known{i} = _events AND _low{i} = _high{i})" for i in range(n)) or "true"
    checked = trials.where(f"CASE WHEN {constant} THEN true ELSE raise_error('attributes differ within a trial') END")
    # new columns behind a generator: a later filter "response_corr = 1" would otherwise be
    # joined with the check, and the optimizer would put the 1 into it for every trial
    coded = [(f"_low{i}", c, levels) for i, (c, levels) in enumerate(attributes.items())]
    values = {c: at if levels is None else label_at(at, levels) for at, c, levels in coded}
    return drop(compute_once(checked, {**values, **(more or {})}), "_events", *(f"_{part}{i}" for i in range(n) for part in ("low", "high", "known")))


def trial_markers(
    events: DataFrame, attributes: Mapping[str, Sequence[str] | None] = TRIAL_ATTRIBUTES, unique_keys: bool = False
) -> DataFrame:
    """One row per trial from classified events, in one shuffle of partial results.

    ``attributes`` are columns that are constant within a trial, and their levels. Labels
    go through the aggregation as ranks; minimum, maximum and count tell whether
    one varies within a trial, and that raises, as does a missing event key.

    ``fix_count`` must be unique within a trial. ``sources.stored_events`` checks it once,
    when events are stored, and ``sources.trial_logs.validated`` when they are read. With
    ``unique_keys`` it is checked here: distinct indexes are counted in the same
    aggregation, at the price of moving every (trial, index) once.
    """
    search = "cat = 'Search'"
    on_target = f"{search} AND fix_type = 'Target'"
    on_t1 = f"{search} AND tar_fixed = 1"
    on_t2 = f"{search} AND tar_fixed = 2"
    on_dist = f"{search} AND fix_type = 'Distractor'"
    off_centre = f"{search} AND fix_type <> 'Fixation'"

    def index_if(cond: str) -> str:
        return f"CASE WHEN {cond} THEN fix_count END"

    def first(cond: str) -> str:
        return f"min({index_if(cond)})"

    def last(cond: str) -> str:
        return f"max({index_if(cond)})"

    def at_first(value: str, cond: str) -> str:
        return f"min_by({value}, {index_if(cond)})"

    coded, checks = attribute_states(known_keys(events), attributes)
    if unique_keys:
        checks["_indexes"] = "count(DISTINCT fix_count)"
    grouped = coded.groupBy(*TRIAL).agg(
        *aggregates(
            checks
            | {
                "_events": "count(1)",
                "n_search": f"count({index_if(search)})",
                "first_search": first(search),
                "first_target": first(on_target),
                "first_target_time": at_first("start_time", on_target),
                "first_target_duration": at_first("duration", on_target),
                "_first1": first(on_t1),
                "_last1": last(on_t1),
                "_time1": at_first("start_time", on_t1),
                "_dur1": at_first("duration", on_t1),
                "_first2": first(on_t2),
                "_last2": last(on_t2),
                "_time2": at_first("start_time", on_t2),
                "_dur2": at_first("duration", on_t2),
                "first_distractor": first(on_dist),
                "first_distractor_time": at_first("start_time", on_dist),
                "_object": at_first(rank_of("fix_type", EVENT_CLASSES), off_centre),
            }
        )
    )

    if unique_keys:
        unique = "CASE WHEN _indexes = _events THEN true ELSE raise_error('an event key is repeated') END"
        grouped = drop(grouped.where(unique), "_indexes")
    grouped = attribute_values(grouped, attributes, {"n_events": "_events"})

    # the first visit to "the other" target is the later of the two first visits
    def other(one: str, two: str) -> str:
        return f"CASE first_target WHEN _first1 THEN {two} WHEN _first2 THEN {one} END"

    derived = add(
        grouped,
        {
            "first_target_id": "CASE first_target WHEN _first1 THEN 1 WHEN _first2 THEN 2 END",
            "both_targets": other("_first1", "_first2"),
            "both_targets_time": other("_time1", "_time2"),
            "second_target_duration": other("_dur1", "_dur2"),
            "first_object": label_at("_object", EVENT_CLASSES),
            "fix_pattern": visit_pattern("_first1", "_last1", "_first2", "_last2"),
        },
    )
    return drop(derived, "_first1", "_last1", "_time1", "_dur1", "_first2", "_last2", "_time2", "_dur2", "_object")
