"""Where the items of a display are, and what that means for a trial."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.nulls import ifelse3
from ..functions.sql import add, compute_once, drop, literals
from .lagged import previous_value

# Orientation columns of display positions 1..10 and the
# orientations that mark a target and a distractor.
ORIENTATION_COLUMNS = (
    "ori10", "ori11", "ori12", "ori13", "ori14",
    "ori16", "ori17", "ori18", "ori19", "ori20",
)
TARGET_ORIENTATIONS = (12.0, -12.0, 168.0, -168.0)
DISTRACTOR_ORIENTATIONS = (270.0, 90.0)
HALF = 5

# Labels of the result.
REGIONS = ("Absent", "Freq.", "Rare")


def match_mask(columns: Sequence[str], values: Sequence[float]) -> str:
    """Bit i - 1 is set if the i-th column has a listed value; a NULL never matches.

    Wide rows are searched in generated code, without unpivoting or shuffling
    them, and every column is tested once however many positions are asked for.
    """
    listed = literals(values)
    return " + ".join(f"CASE WHEN {c} IN ({listed}) THEN {1 << i} ELSE 0 END" for i, c in enumerate(columns))


def kth_match(mask: str, k: int) -> str:
    """1-based index of the k-th set bit, NULL if there are fewer."""
    for _ in range(k - 1):
        mask = f"({mask} & ({mask} - 1))"
    return f"CASE WHEN {mask} <> 0 THEN bit_count(({mask} & -{mask}) - 1) + 1 END"


def item_positions(trials: DataFrame) -> DataFrame:
    """Add positions of both targets (NULL if missing) and of the distractor (0 if absent)."""
    masks = {
        "_targets": match_mask(ORIENTATION_COLUMNS, TARGET_ORIENTATIONS),
        "_distractors": match_mask(ORIENTATION_COLUMNS, DISTRACTOR_ORIENTATIONS),
    }
    found = add(
        compute_once(trials, masks),
        {
            "tar1_pos": kth_match("_targets", 1),
            "tar2_pos": kth_match("_targets", 2),
            "dist_pos": f"coalesce({kth_match('_distractors', 1)}, 0)",
        },
    )
    return drop(found, *masks)


def _half_label(pos: str, frequent: str, rare: str) -> str:
    bottom = f"{pos} > {HALF}"
    return ifelse3(
        "dist_freq = 'freq_bottom'",
        ifelse3(bottom, f"'{frequent}'", f"'{rare}'"),
        ifelse3(bottom, f"'{rare}'", f"'{frequent}'"),
    )


def distractor_region(df: DataFrame) -> DataFrame:
    """Add region (Absent / Freq. / Rare) and presence of the distractor."""
    return add(
        df,
        {
            "dist_region": ifelse3("dist_pos = 0", "'Absent'", _half_label("dist_pos", "Freq.", "Rare")),
            "distractor": ifelse3("dist_pos > 0", "'Present'", "'Absent'"),
        },
    )


def target_regions(df: DataFrame) -> DataFrame:
    """Add the region of each target and the label of the pair."""
    out = add(
        df,
        {
            "tar1_region": _half_label("tar1_pos", "Frequent", "Rare"),
            "tar2_region": _half_label("tar2_pos", "Frequent", "Rare"),
        },
    )
    same = ifelse3("tar1_region = 'Frequent'", "'Freq. dist.'", "'Rare dist.'")
    return add(out, {"tar_regions": ifelse3("tar1_region = tar2_region", same, "'Freq./Rare dist.'")})


def first_target_region(df: DataFrame) -> DataFrame:
    """Add the region of the target that was visited first."""
    return add(df, {"first_region_fixed": ifelse3("first_target_id = 1", "tar1_region", "tar2_region")})


def distractor_repeat(trials: DataFrame) -> DataFrame:
    """Add Absent / Repeat / Change against the participant's previous trial by number."""
    lagged = previous_value(trials, ["participant"], "tno", "dist_pos", "_prev_pos")
    repeat = ifelse3("dist_pos = _prev_pos", "'Repeat'", "'Change'")
    return drop(add(lagged, {"dist_rep": ifelse3("dist_pos = 0", "'Absent'", repeat)}), "_prev_pos")
