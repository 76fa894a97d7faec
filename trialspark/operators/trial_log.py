"""Clean-up of the trial log: blocks, trial numbers, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import recode
from ..functions.nulls import ifelse3
from ..functions.sql import add

# Response levels in the log and their labels.
RESPONSE_LABELS = {"resp": "Go", "inhibit": "No-go"}
RESPONSES = tuple(RESPONSE_LABELS.values())
MIN_RT_SECONDS = 0.2


def trial_blocks(log: DataFrame) -> DataFrame:
    """Add block type and trial number from the main or the practice index."""
    return add(
        log,
        {
            "blocktype": ifelse3("trials_thisN IS NULL", "'Practice'", "'Experiment'"),
            "tno": "CAST(coalesce(trials_thisN, practice_trials_thisRepN) AS INT)",
        },
    )


def experiment_trials(log: DataFrame) -> DataFrame:
    return trial_blocks(log).where("blocktype = 'Experiment'")


def label_response(df: DataFrame, column: str = "response") -> DataFrame:
    return df.withColumn(column, F.expr(recode(column, RESPONSE_LABELS)))


def valid_go(trials: DataFrame, min_rt: float | None = MIN_RT_SECONDS) -> DataFrame:
    """Correct Go trials, optionally with a response time above ``min_rt`` seconds."""
    kept = trials.where("response_corr = 1 AND response = 'Go'")
    return kept if min_rt is None else kept.where(f"response_rt > {min_rt}D")
