"""Trial log, fixations and saccades out of a plain user-event table.

Every event value is a function of its own row, so the event relations keep the
partitioning and the column pruning of the scan: no window, no shuffle. Only the
trial log (one row per trial) is an aggregation.

A user's five-day block is a trial; users are folded onto ``PARTICIPANTS``
participants. Displays, responses and correctness follow from the participant and
trial number, gaze and durations from the event's value and properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.categories import recode
from ..functions.sql import add, aggregates, compute_once
from ..operators.positions import ORIENTATION_COLUMNS, distractor_region
from ..operators.trial_log import RESPONSE_LABELS
from .trial_logs import declare

PARTICIPANTS = 15
BLOCK_MICROS = 5 * 86_400 * 1_000_000
BLOCKS = 6
# a block is mapped onto about three seconds; the odd divisor keeps times off the
# midpoints where engines round differently
MICROS_PER_SECOND = BLOCK_MICROS // 3 - 1


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def with_trial_ids(events: DataFrame) -> DataFrame:
    """Add participant number, trial number and time within the trial."""
    return add(
        events,
        {
            "_us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))",
            # props is {"k": number}
            "_k": "TRY_CAST(substring_index(substring_index(props, ':', -1), '}', 1) AS INT)",
            "_pid": f"CAST(user_id % {PARTICIPANTS} AS INT)",
            "participant": f"CAST(user_id % {PARTICIPANTS} AS STRING)",
            # a time outside the month would take the number of another trial; a number
            # that does not fit raises in the cast
            "tno": f"CASE WHEN _us >= 0 AND _us < {BLOCKS * BLOCK_MICROS} THEN CAST(user_id div {PARTICIPANTS} * {BLOCKS}"
            f" + _us div {BLOCK_MICROS} AS INT) WHEN _us IS NOT NULL THEN raise_error('event time outside the six blocks') END",
            "_seconds": f"_us % {BLOCK_MICROS} / {MICROS_PER_SECOND}",
        },
    )


def with_display(df: DataFrame) -> DataFrame:
    """Add item positions, distractor rule, response and correctness of the trial."""
    drawn = add(
        df,
        {
            "_a": "(_pid + tno) % 10 + 1",
            "_b": "(_pid + tno + 3 + tno % 4) % 10 + 1",
            "_d": "CASE WHEN (_pid * 7 + tno * 3) % 4 = 0 THEN 0"
            " ELSE CAST((_pid * 3 + tno div 2 * 7) % 10 + 1 AS INT) END",
        },
    )
    return compute_once(
        drawn,
        {
            "tar1_pos": "least(_a, _b)",
            "tar2_pos": "greatest(_a, _b)",
            "dist_pos": "CASE WHEN _d IN (_a, _b) THEN _d % 10 + 1 ELSE _d END",
            "dist_freq": "CASE WHEN _pid % 2 = 0 THEN 'freq_bottom' ELSE 'freq_top' END",
            "response": "CASE WHEN (_pid + tno * 3) % 5 < 3 THEN 'resp' ELSE 'inhibit' END",
            "response_corr": "CASE WHEN (_pid * 3 + tno * 7) % 11 = 0 THEN 0 ELSE 1 END",
        },
    )


def fixations(events: DataFrame, relabel: bool = True) -> DataFrame:
    """Fixation events; ``relabel`` turns raw responses into Go / No-go."""
    radius = "(2.503D + value - 6 * floor(value / 6))"
    angle = "_k * pi() / 50"
    response = recode("response", RESPONSE_LABELS) if relabel else "response"
    return distractor_region(with_display(with_trial_ids(events))).selectExpr(
        "participant",
        "tno",
        "CASE WHEN event_type = 'signup' THEN 'Post' ELSE 'Search' END AS cat",
        "event_id AS fix_count",
        "_seconds + 0.05D AS start_time",
        "value / 1000 AS duration",
        # k = 99 stands for an untracked gaze
        f"CASE WHEN _k < 99 THEN {radius} * cos({angle}) END AS average_gaze_x",
        f"CASE WHEN _k < 99 THEN {radius} * sin({angle}) END AS average_gaze_y",
        "tar1_pos",
        "tar2_pos",
        "dist_pos",
        "dist_freq",
        "dist_region",
        f"{response} AS response",
        "response_corr",
        "0.15D + _k / 100D AS response_rt",
    )


def saccades(events: DataFrame) -> DataFrame:
    """One saccade shortly before every fixation, with the raw response."""
    return fixations(events, relabel=False).selectExpr(
        "participant",
        "tno",
        "cat",
        "start_time - 0.02D AS start_time",
        "0D AS search_start_time",
        "dist_region",
        "response",
        "response_corr",
    )


def trial_log(events: DataFrame) -> DataFrame:
    """Raw trial log: one row per trial, practice rows without a main index."""
    per_trial = with_trial_ids(events).groupBy("_pid", "participant", "tno")
    df = with_display(per_trial.agg(*aggregates({"_first_k": "min_by(_k, event_id)"})))
    df = compute_once(df, {"_turned": "CASE WHEN tno % 2 = 0 THEN 90D ELSE 270D END"})
    return df.selectExpr(
        "participant",
        "CASE WHEN tno <> 0 THEN tno END AS `trials.thisN`",
        "CASE WHEN tno = 0 THEN tno END AS `practice_trials.thisRepN`",
        *[
            f"CASE {i} WHEN tar1_pos THEN 12D WHEN tar2_pos THEN -168D WHEN dist_pos THEN _turned ELSE 0D END AS {c}"
            for i, c in enumerate(ORIENTATION_COLUMNS, 1)
        ],
        "dist_freq",
        "CASE WHEN (_pid + tno * 5) % 97 = 0 THEN 'none' ELSE response END AS respon",
        "response_corr AS `response.corr`",
        "CASE WHEN response = 'resp' THEN 0.15D + _first_k / 100D END AS `response.rt`",
    )


def load_trial_log(spark: SparkSession, directory: str) -> DataFrame:
    return declare(trial_log(read_table(spark, directory, "events")))


def load_fixations(spark: SparkSession, directory: str, relabel: bool = True) -> DataFrame:
    return fixations(read_table(spark, directory, "events"), relabel)


def load_saccades(spark: SparkSession, directory: str) -> DataFrame:
    return saccades(read_table(spark, directory, "events"))
