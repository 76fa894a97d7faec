"""Analyses of the fixation table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.nulls import mean_strict
from ..functions.sql import add, aggregates, drop
from ..operators.attach import TRIAL
from ..operators.classify import classify
from ..operators.errors import within_error
from ..operators.exclude import drop_with_missing, keep_with_cells, keep_with_count
from ..operators.markers import trial_markers
from ..operators.phases import distractor_phases, trial_phase_flags
from ..operators.positions import target_regions
from ..operators.reshape import spread_statistics, to_long, to_wide
from ..operators.summarize import cell_mean, share_within, sum_at_first, two_level_mean
from ..operators.trial_log import RESPONSES, valid_go
from ..operators.visits import see_items, trial_visits

CELL = ["dist_region", "response"]
#: everything a display may hold: two targets and, in some trials, a distractor
DISPLAY = {"target 1": "tar1_pos", "target 2": "tar2_pos", "distractor": "dist_pos"}
PHASE_MEASURES = ("before", "between", "after")


def markers_of(fixations: DataFrame) -> DataFrame:
    return trial_markers(classify(fixations))


def pattern_share(fixations: DataFrame) -> DataFrame:
    """Share of each visit pattern among the trials of a response."""
    trials = markers_of(fixations).where("response IS NOT NULL")
    return share_within(trials, ["response"], "fix_pattern")


def first_object_share(fixations: DataFrame) -> DataFrame:
    """Share of each class among the first off-centre events of correct distractor trials."""
    trials = markers_of(fixations).where(
        "response_corr = 1 AND dist_region <> 'Absent' AND first_object IS NOT NULL"
    )
    return share_within(trials, CELL, "first_object").withColumnRenamed("first_object", "fix_type")


def display_visits(fixations: DataFrame) -> DataFrame:
    """Visits of all items of the display, targets and distractor alike."""
    return trial_visits(see_items(fixations, DISPLAY), DISPLAY)


def display_visit_share(fixations: DataFrame) -> DataFrame:
    """Share of each visit pattern of the whole display among correct trials of a cell."""
    return share_within(display_visits(fixations).where("response_corr = 1 AND response IS NOT NULL"), CELL, "visit_pattern")


def display_scan_time(fixations: DataFrame) -> DataFrame:
    """Within-subject summary of the time in ms from the first item seen to the last one, where all were seen."""
    complete = display_visits(fixations).where("response_corr = 1 AND n_seen > 1 AND all_seen_at IS NOT NULL")
    cells = cell_mean(complete, [*CELL, "participant"], "(all_seen_time - first_item_time) * 1000", "scan")
    return within_error(cells, CELL, {"scan": "scan"})


def target_region_cells(fixations: DataFrame) -> DataFrame:
    """Mean response time in ms per target region pair and participant, no distractor."""
    rows = valid_go(target_regions(fixations), min_rt=None)
    rows = rows.where("dist_region = 'Absent' AND tar_regions IS NOT NULL")
    return two_level_mean(rows, ["tar_regions", "response", "participant"], "response_rt * 1000", "rt")


def target_region_rt(fixations: DataFrame) -> DataFrame:
    return within_error(target_region_cells(fixations), ["tar_regions", "response"], {"rt": "rt"})


def _correct_events(fixations: DataFrame, present: bool = True) -> DataFrame:
    """Classified events of correct trials, optionally only those that have a distractor."""
    events = classify(fixations).where("response_corr = 1")
    return events.where("dist_region <> 'Absent'") if present else events


def _phase_trials(events: DataFrame, need_both: bool) -> DataFrame:
    """Trials with search events, optionally only those with both targets visited."""
    kept = trial_markers(events).where("n_search > 0")
    return kept.where("both_targets IS NOT NULL") if need_both else kept


def _phase_cells(flags: DataFrame, by: list[str]) -> DataFrame:
    shares = {m: mean_strict(f"CAST({m} AS INT)") for m in PHASE_MEASURES}
    return flags.groupBy(*by, "participant").agg(*aggregates(shares))


def phase_prop(fixations: DataFrame) -> DataFrame:
    """Share of trials with distractor events before / between / after the targets."""
    events = _correct_events(fixations)
    trials = _phase_trials(events, need_both=True)
    cells = _phase_cells(trial_phase_flags(events, trials, CELL), CELL)
    return within_error(cells, CELL, {m: m for m in PHASE_MEASURES})


def phase_prop_norep(fixations: DataFrame, repeats: DataFrame, need_both: bool) -> DataFrame:
    """As :func:`phase_prop`, only trials whose distractor position changed.

    ``repeats`` holds participant, tno and dist_rep of the trial log. It meets the
    fixations as one row per trial, after the aggregation.
    """
    events = _correct_events(fixations, present=False)
    changed = repeats.where("dist_rep = 'Change'").select(*TRIAL)
    trials = _phase_trials(events, need_both).join(changed, list(TRIAL), "left_semi")
    cells = _phase_cells(trial_phase_flags(events, trials, CELL), CELL)
    return within_error(cells, CELL, {m: m for m in PHASE_MEASURES})


def phase_prop_long(summary: DataFrame) -> DataFrame:
    """Phase summary with one row per phase and the columns m and ci."""
    return spread_statistics(summary, CELL, ["m", "ci"], PHASE_MEASURES, "fix_type")


def distractor_duration_cells(fixations: DataFrame) -> DataFrame:
    """Duration in ms of the first distractor event before and after the targets."""
    events = _correct_events(fixations, present=False)
    trials = _phase_trials(events, need_both=True)
    labelled = distractor_phases(events, trials, CELL).where("both_targets IS NOT NULL AND dfix_type <> 'Between'")
    by = [*CELL, "dfix_type", "participant"]
    first = sum_at_first(labelled, [*by, "tno"], "fix_count", "duration", "dur")
    cells = cell_mean(first, by, "dur * 1000", "dur")
    return to_wide(cells, [*CELL, "participant"], "dfix_type", ["Before", "After"], "dur")


def distractor_duration(fixations: DataFrame) -> DataFrame:
    """First distractor durations of participants that have both phases in all their cells."""
    wide = distractor_duration_cells(fixations)
    long = to_long(drop_with_missing(wide, ["After", "Before"]), [*CELL, "participant"], ["Before", "After"], "type", "dur")
    return within_error(long, [*CELL, "type"], {"dur": "dur"})


def target_duration(fixations: DataFrame) -> DataFrame:
    """Durations of the first events on the first and on the second target."""
    events = (("First", "first_target", "first_target_duration"), ("Second", "both_targets", "second_target_duration"))
    rows = ", ".join(f"named_struct('tar_fixed', '{tag}', 'at', {at}, 'dur', {dur})" for tag, at, dur in events)
    correct = markers_of(fixations).where("response_corr = 1")
    stacked = correct.selectExpr(*CELL, "participant", f"inline(array({rows}))").where("at IS NOT NULL")
    cells = cell_mean(stacked, [*CELL, "tar_fixed", "participant"], "dur * 1000", "dur")
    return within_error(cells, [*CELL, "tar_fixed"], {"dur": "dur"})


def refixation_cells(fixations: DataFrame) -> DataFrame:
    """Share of trials with a distractor event after both targets, by whether there was one before.

    Only trials without a distractor event between the targets.
    """
    events = _correct_events(fixations)
    trials = _phase_trials(events, need_both=True)
    flags = trial_phase_flags(events, trials, CELL).where("NOT between")
    cells = cell_mean(flags, ["before", *CELL, "participant"], "CAST(after AS INT)", "after")
    return drop(add(cells, {"before_fix": "CASE WHEN before THEN 'Fix.' ELSE 'No fix.' END"}), "before")


def refixation_after(fixations: DataFrame, all_cells: int | None = None) -> DataFrame:
    """Within-subject summary of :func:`refixation_cells` for complete participants.

    Complete: has the Rare / Fix. cell for both responses, or, if ``all_cells`` is
    given, exactly that number of cells.
    """
    cells = refixation_cells(fixations)
    if all_cells is None:
        rare = "before_fix = 'Fix.' AND dist_region = 'Rare'"
        kept = keep_with_cells(cells, [f"{rare} AND response = '{r}'" for r in RESPONSES])
    else:
        kept = keep_with_count(cells, all_cells)
    return within_error(kept, ["before_fix", *CELL], {"after": "after"})
