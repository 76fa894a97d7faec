"""Label distractor events by phase of their trial and reduce them per trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.nulls import any_true, ifelse3
from ..functions.sql import add, aggregates, drop, quoted
from .attach import TRIAL, attach


def phase_label() -> str:
    """Before the first target, between first and both targets, or after both."""
    late = ifelse3("both_targets IS NULL OR fix_count < both_targets", "'Between'", "'After'")
    return ifelse3("first_target IS NULL OR fix_count < first_target", "'Before'", late)


IS_DISTRACTOR = "cat = 'Search' AND fix_type = 'Distractor'"


def label_phases(events: DataFrame, markers: DataFrame, **split) -> DataFrame:
    """Every event with the column ``dfix_type``: the phase of distractor events, NULL for the others."""
    labelled = attach(events, markers.select(*TRIAL, "first_target", "both_targets", "n_events"), "n_events", **split)
    return drop(add(labelled, {"dfix_type": f"CASE WHEN {IS_DISTRACTOR} THEN {phase_label()} END"}), "first_target", "both_targets")


def distractor_phases(events: DataFrame, markers: DataFrame, keep: Sequence[str] = (), **split) -> DataFrame:
    """Distractor events of the search phase with the phase they fall into.

    Only these events are moved; ``keep`` names further marker columns to carry.
    """
    hits = events.where(IS_DISTRACTOR).select(*TRIAL, "fix_count", "duration")
    per_trial = markers.select(*TRIAL, "first_target", "both_targets", *keep, "n_events")
    return add(attach(hits, per_trial, "n_events", **split), {"dfix_type": phase_label()})


def trial_phase_flags(events: DataFrame, trials: DataFrame, attributes: Sequence[str], **split) -> DataFrame:
    """Per trial: was there a distractor event before / between / after.

    ``trials`` is a marker table already reduced to the trials of interest; one
    without any distractor event gets three false flags. Events are reduced to one
    row per trial before they meet the trials.
    """
    labelled = distractor_phases(events, add(trials, {"_listed": "true"}), ["_listed"], **split).where("_listed")
    names = {p.lower(): any_true(f"dfix_type = '{p}'") for p in ("Before", "Between", "After")}
    flags = labelled.groupBy(*TRIAL).agg(*aggregates({f"_{n}": sql for n, sql in names.items()}))
    joined = trials.select(*TRIAL, *attributes).join(flags, list(TRIAL), "left")
    return joined.selectExpr(*TRIAL, *map(quoted, attributes), *[f"coalesce(_{n}, false) AS {n}" for n in names])
