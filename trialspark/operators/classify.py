"""Assign events to areas of interest by distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.geometry import AOI_RADIUS, distance, item_distance
from ..functions.nulls import ifelse3
from ..functions.sql import add, compute_once, drop, literal

# rank order used where the class is carried as an integer
# Labels of the result.
EVENT_CLASSES = ("Distractor", "Target", "Other", "Fixation")
DISTANCES = ("tar1_dist", "tar2_dist", "dist_dist", "fix_dist")


def gaze_distances(events: DataFrame) -> DataFrame:
    """Add distances of the gaze to both targets, the distractor and the centre."""
    gaze = ("average_gaze_x", "average_gaze_y")
    return add(
        events,
        {
            "tar1_dist": item_distance("tar1_pos", *gaze),
            "tar2_dist": item_distance("tar2_pos", *gaze),
            "dist_dist": item_distance("dist_pos", *gaze),
            "fix_dist": distance(*gaze, "0D", "0D"),
        },
    )


def event_class() -> str:
    """Target, else Fixation (centre), else Distractor, else Other; NULL if unknown.

    Areas of neighbouring items overlap, so a target only counts if the
    distractor is not strictly nearer.
    """
    near = literal(AOI_RADIUS)

    def on_target(d: str) -> str:
        return f"({d} < {near} AND {d} <= coalesce(dist_dist, {d}))"

    on_distractor = f"dist_dist IS NOT NULL AND dist_dist < {near}"
    off_centre = ifelse3(on_distractor, "'Distractor'", "'Other'")
    return ifelse3(
        f"{on_target('tar1_dist')} OR {on_target('tar2_dist')}",
        "'Target'",
        ifelse3(f"fix_dist < {near}", "'Fixation'", off_centre),
    )


def classify_by_distance(events: DataFrame) -> DataFrame:
    """Add ``fix_type`` and the id of the visited target from the distance columns."""
    nearest = ifelse3("tar1_dist < tar2_dist", "1", "2")
    target = f"CASE WHEN _once_fix_type = 'Target' THEN {nearest} END"
    return compute_once(events, {"fix_type": event_class(), "tar_fixed": target})


def classify(events: DataFrame) -> DataFrame:
    """Class and visited target of every event, without the distances."""
    return drop(classify_by_distance(gaze_distances(events)), *DISTANCES)


def circle_outline(layout: DataFrame, x: str, y: str, radius: str, npoints: int = 100) -> DataFrame:
    """Replace each circle of a layout table by ``npoints`` outline points.

    The angle step is 2 pi / (npoints - 1): the last point closes the outline.
    """
    step = literal(2 * math.pi / (npoints - 1))
    points = add(layout, {"point": f"explode(sequence(0, {npoints - 1}))"})
    return add(
        points,
        {
            "outline_x": f"{x} + {radius} * cos(point * {step})",
            "outline_y": f"{y} + {radius} * sin(point * {step})",
        },
    )
