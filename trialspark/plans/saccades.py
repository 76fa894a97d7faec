"""Latency of the saccade that led to a target or a distractor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.sql import add, drop, literals
from ..operators.asof import last_before
from ..operators.attach import TRIAL, natural_full, row_counts
from ..operators.errors import within_error
from ..operators.exclude import keep_with_cells
from ..operators.positions import REGIONS
from ..operators.summarize import two_level_mean

MIN_LATENCY_MS = 50
MAX_LATENCY_MS = 500
MARKERS = {
    "Target": ("first_target", "first_target_time"),
    "Distractor": ("first_distractor", "first_distractor_time"),
}


def leading_saccades(saccades: DataFrame, markers: DataFrame, kinds: Sequence[str] = tuple(MARKERS)) -> DataFrame:
    """Last saccade before the first event on a target / distractor, with its latency.

    The last saccade is found over all phases; the trial is dropped if that one
    is not a search saccade. The trial's first search event comes along. Heavy
    trials are found by their own number of saccades.
    """
    points = {k: MARKERS[k] for k in kinds}
    sized = markers.join(row_counts(saccades, TRIAL, "_found"), list(TRIAL), "left")
    sized = add(sized, {"n_saccades": "coalesce(_found, 0L)"})
    rows = last_before(saccades, sized, "start_time", points, weight="n_saccades", carry=["first_search"])
    return add(rows.where("cat = 'Search'"), {"latency": "(start_time - search_start_time) * 1000"})


def with_first_search(saccades: DataFrame, markers: DataFrame, kinds: Sequence[str] = tuple(MARKERS)) -> DataFrame:
    """Leading saccades of each kind, and first search events, of all trials that have either.

    One as-of pass serves all kinds; the two per-trial tables are joined by trial and kind.
    """
    leading = drop(leading_saccades(saccades, markers, kinds), "first_search").withColumnRenamed("type", "kind")
    first = markers.where("first_search IS NOT NULL").selectExpr(*TRIAL, "first_search", f"explode(array({literals(kinds)})) AS kind")
    return natural_full(leading, first)


def latency_all(saccades: DataFrame, markers: DataFrame) -> DataFrame:
    """Mean latency per type, region, response and participant on correct trials."""
    rows = leading_saccades(saccades, markers).where("response_corr = 1")
    return two_level_mean(rows, ["type", "dist_region", "response", "participant"], "latency", "latency")


def latency_first(saccades: DataFrame, markers: DataFrame) -> DataFrame:
    """Mean latency per type on correct trials whose first search event was the marker event.

    The marker and the first search event are compared in the rows, so the full
    join of two per-trial tables that would bring them together is not needed.
    """
    rows = leading_saccades(saccades, markers).where(
        f"response_corr = 1 AND marker = first_search AND latency > {MIN_LATENCY_MS} AND latency < {MAX_LATENCY_MS}"
    )
    return two_level_mean(rows, ["type", "dist_region", "participant"], "latency", "latency")


def first_latency_summary(saccades: DataFrame, markers: DataFrame) -> DataFrame:
    """Target and distractor latency of participants that have target data in every region."""
    required = [f"type = 'Target' AND dist_region = '{r}'" for r in REGIONS]
    cells = keep_with_cells(latency_first(saccades, markers), required)
    return within_error(cells, ["dist_region", "type"], {"lat": "latency"})
