"""Analyses of the trial log: response time, accuracy, position repeats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.nulls import ifelse3, isin_safe
from ..functions.sql import add, literal
from ..operators.errors import within_error
from ..operators.positions import distractor_region, distractor_repeat, item_positions
from ..operators.summarize import cell_mean
from ..operators.trial_log import experiment_trials, label_response, valid_go


def prepared_trials(log: DataFrame) -> DataFrame:
    """Experiment trials with positions, region and labelled response."""
    return label_response(distractor_region(item_positions(experiment_trials(log))))


def trials_with_repeats(log: DataFrame) -> DataFrame:
    return distractor_repeat(prepared_trials(log))


def rt_by_region(trials: DataFrame) -> DataFrame:
    """Mean response time in ms per region and participant, valid Go trials."""
    by = ["dist_region", "distractor", "participant"]
    return cell_mean(valid_go(trials), by, "response_rt * 1000", "rt")


def accuracy_by_region(trials: DataFrame) -> DataFrame:
    """Accuracy and error rate per region, response and participant."""
    cells = cell_mean(trials, ["dist_region", "distractor", "response", "participant"], "response_corr", "acc")
    return add(cells, {"err": "1 - acc"})


def within_rt(trials: DataFrame) -> DataFrame:
    return within_error(rt_by_region(trials), ["dist_region", "distractor"], {"rt": "rt"})


def within_accuracy(trials: DataFrame, pool_responses: bool) -> DataFrame:
    """Accuracy with within-subject error.

    Pooled: the rows of all responses fall into one cell per region, so n counts
    participant-response rows. Otherwise cells are per response and Go is kept,
    after both responses have entered the participant mean.
    """
    cells = accuracy_by_region(trials)
    if pool_responses:
        return within_error(cells, ["dist_region", "distractor"], {"acc": "acc"})
    return within_error(cells, ["dist_region", "distractor", "response"], {"pc": "acc"}).where("response = 'Go'")


def norep_rt(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Response time per region without trials that repeat the distractor position.

    ``by`` names further columns to report by, such as an experiment tag: several
    experiments then take one pass, provided that no participant id is in two of them.
    """
    kept = trials.where(isin_safe("dist_rep", ["Absent", "Change"]))
    cells = cell_mean(valid_go(kept), [*by, "dist_region", "participant"], "response_rt * 1000", "rt")
    cells = add(cells, {"dist_present": ifelse3("dist_region = 'Absent'", "'Absent'", "'Present'")})
    return within_error(cells, [*by, "dist_region", "dist_present"], {"rt": "rt"})


def tagged_logs(logs: dict[str, DataFrame]) -> DataFrame:
    """Trial logs of several experiments stacked under an ``experiment`` tag, with participant ids that hold the tag."""
    own = "concat(experiment, ':', participant)"
    tagged = [add(log, {"experiment": literal(name)}).selectExpr("* EXCEPT (participant)", f"{own} AS participant") for name, log in logs.items()]
    return reduce(DataFrame.unionByName, tagged)


def side_by_side(summaries: dict[str, DataFrame]) -> DataFrame:
    """Stack finished summaries of several experiments, such as stored ones, under an ``experiment`` tag."""
    tagged = [add(s, {"experiment": literal(name)}) for name, s in summaries.items()]
    return reduce(DataFrame.unionByName, tagged)
