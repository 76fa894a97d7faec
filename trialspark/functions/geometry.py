"""Ring layout and distances."""

from __future__ import annotations

import math

from .sql import literals

# Angle in degrees of display positions 1..10, ring radius, and
# the radius of an area of interest.
POSITION_DEGREES = (30, 60, 90, 120, 150, 210, 240, 270, 300, 330)
RING_RADIUS = 6.0
AOI_RADIUS = 3.0


def _lookup(values: list[float], pos: str) -> str:
    # get() gives NULL for position 0 (absent item) and for a NULL position
    return f"get(array({literals(values)}), {pos} - 1)"


def item_x(pos: str) -> str:
    return _lookup([RING_RADIUS * math.cos(math.radians(d)) for d in POSITION_DEGREES], pos)


def item_y(pos: str) -> str:
    return _lookup([RING_RADIUS * math.sin(math.radians(d)) for d in POSITION_DEGREES], pos)


def distance(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(power({x1} - {x2}, 2) + power({y1} - {y2}, 2))"


def item_distance(pos: str, x: str, y: str) -> str:
    """Distance of a point to a display position, NULL if there is no item."""
    return distance(item_x(pos), item_y(pos), x, y)
